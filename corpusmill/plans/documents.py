"""PDF files to page texts in one plan: pages, their types, recognised and described images, assembly by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as tx
from ..operators import layout
from ..params import DEFAULT, Params
from ..sources import pdf

#: Tables of pages that a plug-in has read: array of tables of rows of cells.
TABLES = "path string, page int, tables array<array<array<string>>>"


def page_texts(files: DataFrame, p: Params = DEFAULT, captioner: plugins.Captioner = plugins.described, recognizer: plugins.Recognizer = plugins.no_lines, tables: DataFrame | None = None, other=None) -> DataFrame:
    """path, page, page_type, text, error of each page of files (path, content).

    Text pages are their text. Mixed pages are text, tables (of a plug-in) and
    the descriptions of their images. Scanned pages are the lines that the
    recognizer reads in their images, from top to bottom, or the descriptions
    where it reads none. Pages whose images could not be looked at are text.
    """
    pages = pdf.load_pages(files, other)
    typed = pages.withColumn("page_type", layout.page_type(F.coalesce(F.trim("text"), F.lit("")) != "", F.col("images"), p))
    images = pdf.load_images(files)
    seen = plugins.recognize(plugins.caption(images, captioner, p), recognizer, p).select("path", "page", "name", "caption", "lines")
    of_page = seen.groupBy("path", "page").agg(F.sort_array(F.collect_list(F.struct("name", "caption", "lines"))).alias("seen"))
    full = typed.join(of_page, ["path", "page"], "left")
    if tables is not None:
        full = full.join(tables, ["path", "page"], "left")
    captions = F.filter(F.transform(F.coalesce("seen", F.array()), lambda x: x["caption"]), lambda c: c.isNotNull())
    lines = F.flatten(F.transform(F.coalesce("seen", F.array()), lambda x: x["lines"]))
    of_tables = F.coalesce(F.col("tables"), F.array()) if tables is not None else F.array().cast("array<array<array<string>>>")
    scanned = layout.scanned_page(lines)
    text = (
        F.when(F.col("page_type") == "text_mix_pdf", layout.mixed_page(F.col("text"), of_tables, captions))
        .when(F.col("page_type") == "scan_pdf", F.when(tx.strip(scanned) != "", scanned).otherwise(F.array_join(captions, "\n")))
        .otherwise(F.col("text"))
    )
    return full.select("path", "page", F.when(F.col("error").isNull(), F.col("page_type")).alias("page_type"), text.alias("text"), "error")
