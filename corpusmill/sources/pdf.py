"""Pages of PDF files with the standard library: text, sizes of images, and why a file can't be read.

Covers plain and compressed objects, object streams, and fonts with a map to
Unicode. What it can't read, a plug-in can: operators only ask for rows of
(path, page, text, images).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loaders import docx_images

PAGES = "path string, page int, text string, images array<struct<name:string,w:int,h:int>>, error string"
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"/(?P<font>[^\s/<>\[\]()]+)\s+[-\d.]+\s+Tf|(?P<one>\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|')|\[(?P<many>(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*)\]\s*TJ|(?P<line>T\*|T[dD]\b|Tm\b|\bET\b)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
# What a letter behind a backslash stands for.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Encrypted(ValueError):
    """The file asks for a password."""


class Pdf:
    """The objects of one file."""

    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        self.objects: dict[int, bytes] = {int(n): body for n, body in _OBJECT.findall(content)}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise Encrypted("文件已加密")
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data = self.stream(body)
        first = int(re.search(rb"/First\s+(\d+)", body)[1])  # type: ignore[index]
        numbers = [int(x) for x in data[:first].split()]
        offsets = [*numbers[1::2], len(data) - first]
        for n, a, b in zip(numbers[::2], offsets, offsets[1:]):
            self.objects.setdefault(n, data[first + a : first + b])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = _STREAM.match(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[2]) if b"/FlateDecode" in m[1] else m[2]

    def value(self, body: bytes, name: bytes) -> bytes:
        """What stands behind a name: a reference is followed, else the rest of the dictionary."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*(?:(\d+)\s+\d+\s+R|)", body)
        if not m:
            return b""
        return self.objects.get(int(m[1]), b"") if m[1] else body[m.end() :]

    def references(self, body: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> Iterator[bytes]:
        """Page dictionaries in reading order, with the resources of their parents."""
        is_page = lambda b: re.search(rb"/Type\s*/Page(?![A-Za-z])", b)
        roots = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]

        def walk(n: int, above: bytes, seen: frozenset[int]) -> Iterator[bytes]:
            body = self.objects.get(n, b"")
            if n in seen:
                return
            if is_page(body):
                yield body if b"/Resources" in body else body + above
                return
            for kid in self.references(body, b"Kids"):
                yield from walk(kid, body if b"/Resources" in body else above, seen | {n})

        if roots:
            for n in roots:
                yield from walk(n, b"", frozenset())
        else:
            yield from (b for _, b in sorted(self.objects.items()) if is_page(b))

    def _unicode(self, font: bytes) -> dict[int, str]:
        """Codes of a font as characters; empty if it has no map."""
        data = self.stream(self.value(font, b"ToUnicode")) if b"/ToUnicode" in font else b""
        text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
        found = {}
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
                found[int(a, 16)] = text(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF) + 1):
                    found[k] = chr(int(c, 16) + k - int(a, 16))
        return found

    @staticmethod
    def _bytes(token: bytes) -> bytes:
        if token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)

    def text(self, page: bytes) -> str:
        fonts = self.value(self.value(page, b"Resources"), b"Font")
        maps = {name: self._unicode(self.objects.get(int(n), b"")) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts)}
        data = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.references(page, b"Contents"))
        out: list[str] = []
        own: dict[int, str] = {}

        def show(token: bytes) -> str:
            raw = self._bytes(token)
            if own and token[:1] == b"<":
                return "".join(own.get(int.from_bytes(raw[k : k + 2], "big"), "") for k in range(0, len(raw), 2))
            return "".join(own.get(c, chr(c)) for c in raw) if own else raw.decode("cp1252", "replace")

        for m in _SHOWN.finditer(data):
            if m["font"]:
                own = maps.get(m["font"], {})
            elif m["one"]:
                out.append(show(m["one"]))
            elif m["many"] is not None:
                out.append("".join(show(s) for s in _STRING.findall(m["many"])))
            elif out and out[-1] != "\n":
                out.append("\n")
        return "".join(out).strip()

    def images(self, page: bytes, number: int) -> list[dict]:
        """Names and sizes of the images that a page can draw."""
        out: list[dict] = []
        for n in re.findall(rb"/[^\s/<>\[\]()]+\s+(\d+)\s+\d+\s+R", self.value(self.value(page, b"Resources"), b"XObject")):
            body = self.objects.get(int(n), b"")
            if re.search(rb"/Subtype\s*/Image\b", body):
                size = [int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", body)) else 0 for k in (b"Width", b"Height")]
                kind = "jpg" if b"/DCTDecode" in body else "png"
                out.append({"name": f"p{number}_i{len(out)}.{kind}", "w": size[0], "h": size[1]})
        return out

    def image_bytes(self, page: bytes, number: int) -> list[tuple[str, bytes]]:
        """(name, content) of the images of a page that are JPEG files, or plain grey or RGB samples, which become PNG files."""
        out = []
        bodies = [self.objects.get(int(n), b"") for n in re.findall(rb"/[^\s/<>\[\]()]+\s+(\d+)\s+\d+\s+R", self.value(self.value(page, b"Resources"), b"XObject"))]
        named = self.images(page, number)
        for image, body in zip(named, (b for b in bodies if re.search(rb"/Subtype\s*/Image\b", b)), strict=True):
            m = _STREAM.match(body)
            if b"/DCTDecode" in body:
                out.append((image["name"], m[2] if m else b""))
            else:
                samples, w, h = self.stream(body), image["w"], image["h"]
                for channels, kind in ((1, 0), (3, 2)):
                    if w and h and len(samples) == w * h * channels:
                        out.append((image["name"], png(samples, w, h, kind)))
        return out


def png(samples: bytes, w: int, h: int, kind: int) -> bytes:
    """Samples of eight bits as a PNG file; kind: 0 grey, 2 RGB."""
    size = len(samples) // h
    lines = b"".join(b"\x00" + samples[k * size : (k + 1) * size] for k in range(h))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def load_pages(files: DataFrame, other: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """files: (path, content). A row a page; a file that can't be read is one row with page 0 and its error. other: texts of the pages of a file by another extractor, asked where this one fails; never for encrypted files."""

    def rows(path: str, content: bytes) -> list[dict]:
        try:
            try:
                pdf = Pdf(content)
                found = [{"path": path, "page": k, "text": pdf.text(p), "images": pdf.images(p, k), "error": None} for k, p in enumerate(pdf.pages(), 1)]
            except Encrypted:
                raise
            except Exception:
                if other is None:
                    raise
                found = [{"path": path, "page": k, "text": t, "images": [], "error": None} for k, t in enumerate(other(content), 1)]
            return found or [{"path": path, "page": 0, "text": None, "images": [], "error": "解析结果为空"}]
        except Exception as e:  # a broken file is a row with its error
            return [{"path": path, "page": 0, "text": None, "images": [], "error": f"{type(e).__name__}: {e}"}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(rows(path, bytes(content)), columns=["path", "page", "text", "images", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def load_images(files: DataFrame) -> DataFrame:
    """files: (path, content). path, page, name, content of the images of PDF and DOCX files (page 0); files that can't be read have none."""

    def found(path: str, content: bytes) -> Iterator[tuple[int, str, bytes]]:
        try:
            if content.startswith(b"%PDF"):
                pdf = Pdf(content)
                for k, p in enumerate(pdf.pages(), 1):
                    yield from ((k, name, data) for name, data in pdf.image_bytes(p, k))
            elif path.lower().endswith(".docx"):
                yield from ((0, name, data) for name, data in docx_images(content))
        except Exception:  # load_pages and load_files tell the error
            return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for page, name, data in found(path, bytes(content)):
                    yield pd.DataFrame([(path, page, name, data)], columns=["path", "page", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, name string, content binary")


def complete_files(pages: DataFrame) -> DataFrame:
    """Pages of the files in which every page has text: one blank page fails its file."""
    blank = F.max((F.coalesce(F.trim("text"), F.lit("")) == "").cast("int")).over(Window.partitionBy("path"))
    return pages.withColumn("blank", blank).where("blank = 0").drop("blank")


def page_images(pages: DataFrame) -> DataFrame:
    """path, images: the names of a file's images by page."""
    named = pages.where(F.size("images") > 0).select("path", F.struct("page", F.transform("images", lambda i: i["name"]).alias("names")).alias("entry"))
    return named.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("images"))
