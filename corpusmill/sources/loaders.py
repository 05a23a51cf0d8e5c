"""Loaders of files: text, markdown, office documents, archives. One file is one row and stays in one task."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import parse_markdown
from ..operators.uploads import extension
from ..params import DEFAULT, Params
from . import tables

LOADED = "path string, ext string, text string, toc array<struct<level:int,text:string,path:string>>, chapter_count int, current_chapter string, chapter_level int, image_paths array<string>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, content of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", extension(F.col("path")).alias("ext"), "content")


def decode(content: bytes, p: Params = DEFAULT) -> str:
    """The text in the first encoding that gives more than blanks."""
    for name in p.encodings:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        if text.strip():
            return text
    return ""


def docx(content: bytes) -> tuple[str, list[tuple[int, str]], list[str]]:
    """(text, headings, names of images)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        images = [f"docx_i{k}.{PurePosixPath(n).suffix.lstrip('.') or 'png'}" for k, n in enumerate(n for n in z.namelist() if n.startswith("word/media/"))]
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    lines, headings = [], []
    for par in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in par.iter(f"{_W}t"))
        style = par.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val") if style is not None else ""
        if (m := re.match(r"heading ?(\d*)$", (names.get(name) or name or "").lower())) and text.strip():
            headings.append((max(1, int(m[1] or 1)), text.strip()))
        if text.strip():
            lines.append(text)
    return "\n".join(lines), headings, images


def pptx(content: bytes) -> str:
    """Paragraphs of all text frames, slide by slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        found = [t for n in slides for par in ElementTree.fromstring(z.read(n)).iter(f"{_A}p") if (t := "".join(x.text or "" for x in par.iter(f"{_A}t")).strip())]
    if not found:
        raise ValueError("PPTX 文件解析结果为空")
    return "\n".join(found)


def paths_of(headings: list[tuple[int, str]]) -> list[dict]:
    stack: list[str] = []
    out = []
    for level, text in headings:
        stack = [*stack[: level - 1], text]
        out.append({"level": level, "text": text, "path": " > ".join(stack)})
    return out


def load_files(files: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """files: (path, ext, content). Text and structure of each, or the error; PDF pages come from a plug-in and are typed by operators.layout."""

    def one(path: str, ext: str, content: bytes) -> dict:
        row = {"path": path, "ext": ext, "text": None, "toc": [], "image_paths": [], "error": None}
        try:
            if ext == "txt":
                row["text"] = decode(content, p)
            elif ext == "md":
                row["text"], toc = parse_markdown(decode(content, p))
                row["toc"] = [dict(zip(("level", "text", "path"), t, strict=True)) for t in toc]
            elif ext == "docx":
                row["text"], headings, row["image_paths"] = docx(content)
                row["toc"] = paths_of(headings)
            elif ext == "pptx":
                row["text"] = pptx(content)
            else:
                raise ValueError(f"不支持的文件格式: {ext}")
            if not row["text"].strip():
                raise ValueError("加载内容为空")
        except Exception as e:  # a broken file is a row with its error
            row |= {"text": None, "error": f"{type(e).__name__}: {e}"}
        first = row["toc"][0] if row["toc"] else {"text": "", "level": 0}
        return row | {"chapter_count": len(row["toc"]), "current_chapter": first["text"], "chapter_level": first["level"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", LOADED)]
        for pdf in batches:
            yield pd.DataFrame([one(a, b, bytes(c)) for a, b, c in zip(pdf["path"], pdf["ext"], pdf["content"], strict=True)], columns=names)

    tables.text_batches(files.sparkSession)
    return files.select("path", "ext", "content").mapInPandas(run, LOADED)


def docx_images(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the embedded images, named as docx() names them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        media = [n for n in z.namelist() if n.startswith("word/media/")]
        return [(f"docx_i{k}.{PurePosixPath(n).suffix.lstrip('.') or 'png'}", z.read(n)) for k, n in enumerate(media)]


def expand_archives(archives: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """archives: (path, content). archive, name, content, error of the members; names that lead outside are left out.

    What an archive says of its members' sizes is not trusted: a member is read
    only as far as the limit on all expanded bytes goes. An archive beyond that,
    or beyond the limit on its own size, ends with a row with an error, as does
    one that is broken; no archive fails the job.
    """

    def members(name: str, content: bytes) -> Iterator[tuple[str, Callable]]:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((i.filename, lambda i=i: z.open(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                yield from ((m.name, lambda m=m: t.extractfile(m)) for m in t if m.isfile())

    def rows(path: str, content: bytes) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
        left = p.max_expanded_bytes
        if len(content) > p.max_archive_bytes:
            yield path, None, None, "size_exceeded"
            return
        try:
            for name, open_ in members(path, content):
                parts = PurePosixPath(name.replace("\\", "/")).parts
                if not parts or name.startswith("/") or ".." in parts:
                    continue
                with open_() as f:
                    data = f.read(left + 1)
                left -= len(data)
                if left < 0:
                    yield path, None, None, "size_exceeded"
                    return
                yield path, "/".join(parts), data, None
        except Exception as e:  # a broken archive is a row with its error
            yield path, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for row in rows(path, bytes(content)):
                    yield pd.DataFrame([row], columns=["archive", "name", "content", "error"])

    tables.text_batches(archives.sparkSession)
    return archives.select("path", "content").mapInPandas(run, "archive string, name string, content binary, error string")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ledger; blank and malformed ones are left out."""
    schema = "md5 string, filename string, original_filename string, upload_time string, user_id string, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("md5").isNotNull()).drop("_corrupt_record")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("user_id").json(path)


def delete_from_ledger(spark: SparkSession, path: str, md5: str) -> DataFrame:
    """Raw lines of a ledger without those of a fingerprint; malformed lines stay."""
    lines = spark.read.text(path)
    return lines.where(F.coalesce(F.get_json_object("value", "$.md5"), F.lit("")) != md5)


def encodings_column(content):
    """Text of binary content as decode() sees it."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: decode(bytes(v)) if v is not None else None)

    return run(content)
