"""What pages look like: page types, chart rectangles, blocks of scanned pages, assembly of page parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..params import DEFAULT, Params


def page_type(has_text: Column, images: Column, p: Params = DEFAULT) -> Column:
    """images: array<struct<w, h>>; small ones don't count."""
    seen = F.exists(images, lambda i: (i["w"] > p.image_side) & (i["h"] > p.image_side))
    return F.when(has_text & seen, "text_mix_pdf").when(seen, "scan_pdf").otherwise("text_pdf")


def file_types(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """pages: (file_id, has_text, images). file_id, pdf_type, counts by type; files without a page are text."""
    typed = pages.select("file_id", page_type(F.col("has_text"), F.col("images"), p).alias("t"))
    kinds = ("scan_pdf", "text_mix_pdf", "text_pdf")
    counts = typed.groupBy("file_id").agg(*[F.count_if(F.col("t") == k).alias(k) for k in kinds], F.min("t").alias("one"), F.max("t").alias("two"))
    return counts.select("file_id", F.when(F.col("one") == F.col("two"), F.col("one")).otherwise("mixed").alias("pdf_type"), *kinds)


def type_histogram(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """pages: (file_id, has_text, images). file_id, page_type, n."""
    return pages.groupBy("file_id", page_type(F.col("has_text"), F.col("images"), p).alias("page_type")).agg(F.count(F.lit(1)).alias("n"))


def page_types_or_text(types: Column, n_pages: Column) -> Column:
    """Where pages could not be typed, all are text."""
    return F.coalesce(types, F.array_repeat(F.lit("text_pdf"), n_pages))


def chart_rects(rects: Column, p: Params = DEFAULT) -> Column:
    """array<struct<x0, y0, x1, y1>>: the first large ones."""
    return F.slice(F.filter(rects, lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) > p.chart_area), 1, p.charts_per_page)


def page_blocks(boxes: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """array<struct<x, y, w, h>>: (text boxes, image boxes), both from top to bottom."""
    area = lambda b: b["w"] * b["h"]
    image = lambda b: (area(b) > p.contour_image_area) & (b["w"] > p.contour_image_side) & (b["h"] > p.contour_image_side)
    by_y = lambda a: F.transform(F.array_sort(F.transform(a, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h")))), lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))
    large = F.filter(boxes, lambda b: area(b) >= p.contour_area)
    return by_y(F.filter(large, lambda b: ~image(b))), by_y(F.filter(large, image))


def mixed_page(text: Column, tables: Column, captions: Column) -> Column:
    """Text, tables (arrays of rows of cells) and captions of a page; blank parts are left out."""
    table = F.array_join(F.transform(tables, lambda t: F.array_join(F.transform(t, tx.table_row), "\n")), "\n\n")
    described = F.when(F.size(captions) > 0, F.concat(F.lit("\n\n[图表描述]: "), F.array_join(captions, "\n"))).otherwise("")
    return F.array_join(F.filter(F.array(F.coalesce(text, F.lit("")), table, described), lambda x: tx.strip(x) != ""), "\n\n")


def scanned_page(parts: Column) -> Column:
    """array<struct<y, text>> from top to bottom, blank ones left out."""
    return F.array_join(F.filter(F.transform(F.array_sort(parts), lambda x: x["text"]), lambda x: tx.strip(x) != ""), "\n")


def merge_degradation(counts: DataFrame) -> DataFrame:
    """counts: (file_id, counts map<string, int>). Sums by key, and them as one map by file."""
    by_key = counts.select("file_id", F.explode("counts").alias("key", "n")).groupBy("file_id", "key").agg(F.sum("n").alias("n"))
    return by_key.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))


def captioned(images: DataFrame, cache: DataFrame, groups: DataFrame) -> DataFrame:
    """Caption of each image: its own from the cache, else that of its representative. images: (file_id, seq, path); cache: (path, caption); groups as of phash_groups."""
    own = images.join(groups, ["file_id", "seq"]).join(cache, "path", "left")
    rep = own.select("file_id", F.col("seq").alias("rep_seq"), F.col("caption").alias("rep_caption"))
    return own.join(rep, ["file_id", "rep_seq"], "left").select("file_id", "seq", "path", F.coalesce("caption", "rep_caption").alias("caption"))
