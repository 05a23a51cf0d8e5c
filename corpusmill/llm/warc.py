"""WARC archives with segment reassembly.

Records are written by Spark's own writer, so that a lost executor leaves no
half of a file behind: gzip files of WARC records, each of which begins with a
``warcinfo`` record, in the folder that all executors share. Long records are
cut into a first segment and continuation records. A reader takes files whole,
puts the segments of a record together as far as they lie in the same file,
groups the rest by origin identifier, orders by segment number, verifies the
total length and the digest, and decodes the chunked transfer framing.

``read_records`` reads archives of any writer: several gzip members a file or
none, header lines without blanks or folded, records of other types.

Defined results
* null html: the empty payload; empty payloads are equal like any others
* null url: an empty target; null page_id: its record is always a response
* rows with the same page_id and payload: one outcome, a row each; their
  records have identifiers of their own, and revisits refer to one of them
* ties between equal payloads: the smallest page_id is the response
* very long payloads: as many segments as it takes
* a record whose segments are missing, or whose length, digest or framing is
  wrong, and an archive that is none: a row with an error and without a payload
* empty table: no archive file with records, empty result
* extra or clashing columns: not looked at
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
#: Bytes of a record's block from which it goes on in a continuation record.
SEGMENT_BYTES = 4096
#: Bytes of payload in one chunk of the transfer framing.
CHUNK_BYTES = 1500
#: Records in one archive file at most, so that a reader can hold it.
FILE_RECORDS = 20_000
STAMP = "2024-01-01T00:00:00Z"
#: The alphabets of base 32 digits, as a converter writes them and as the digest has them.
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing, in chunks that do not split a character."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in segments(payload, size) if c]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions of chunks and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + n])
        if len(out[-1]) != n or framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is shorter than its length says")
        at = end + 4 + n


def segments(block: bytes, size: int) -> list[bytes]:
    """The block in pieces that do not split a character."""
    out, at = [], 0
    while len(block) - at > size:
        end = at + size
        while end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def identifier(page_id: int | None, digest: str, number: object = None, segment: int | None = None) -> str:
    """Of a record of a page; number: of a row whose page_id and payload another row has, too."""
    return f"<urn:page:{page_id}:{digest}{'' if number is None else f':{number}'}{'' if segment is None else f'#{segment}'}>"


def warcinfo(own: str) -> bytes:
    """The record that each file begins with."""
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:warcinfo:{own}>"), ("WARC-Date", STAMP), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, number: object, segment_bytes: int) -> list[bytes]:
    """The records of a page without the blank lines behind them."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base32_sha1(payload)
    name = identifier(page_id, digest, number)
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields: list[tuple[str, object]] = [("WARC-Record-ID", name), ("WARC-Date", STAMP), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record([("WARC-Type", "revisit"), *fields, profile, ("WARC-Refers-To", identifier(refers_to, digest))], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = segments(block, segment_bytes)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *fields], block)]
    out = [_record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", identifier(page_id, digest, number, k)), ("WARC-Date", STAMP), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        out.append(_record(more + [("WARC-Segment-Total-Length", len(block))] * (k == len(parts)), part))
    return out


def known_payloads(rows: DataFrame) -> DataFrame:
    """(page_id, key, refers_to, first) of pages that revisit another one, or that several rows have; first: the number of the row whose record has the plain identifier. rows: (u, page_id, key)."""
    pages = common.stored(rows.groupBy("page_id", "key").agg(F.min("u").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    first = common.stored(pages.where("page_id is not null").groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("pages")).where("pages > 1").drop("pages"), "first")
    both = pages.join(first, "key", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")))
    return both.where("refers_to is not null or n > 1").select("page_id", "key", "refers_to", "first")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) below path."""
    keyed = common.stored(pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("key"), F.monotonically_increasing_id().alias("u")), "pages")
    known = common.stored(known_payloads(keyed.select("u", "page_id", "key")), "known").toDF("_page", "_key", "refers_to", "first")
    rows = keyed.join(known, keyed["page_id"].eqNullSafe(known["_page"]) & (keyed["key"] == known["_key"]), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.when(F.col("u") != F.col("first"), F.col("u")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in records(*row, segment_bytes):
                    if n % FILE_RECORDS == 0:  # the writer begins a file here
                        out.append(warcinfo(f"{part}-{n}"))
                        n += 1
                    out.append(r)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def plain(data: bytes) -> bytes:
    """The archive without its gzip members, if it has any."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def header(lines: list[str]) -> dict[str, str]:
    """Fields by name in lower case; a line that begins with a blank goes on with the field before."""
    fields: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, in order."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError("not at the beginning of a record")
        fields = header(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        at = end + 4
        size = fields.get("content-length", "")
        if not size.isdecimal() or len(data) - at < int(size):
            raise ValueError("the archive ends inside a record")
        yield fields, data[at : at + int(size)]
        at += int(size)


#: What is read of a record; its segment's fields and block where others of its segments lie elsewhere.
_FIELDS = [("record_id", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("error", pa.string())]
_ROW = pa.schema([*_FIELDS, ("origin", pa.string()), ("number", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_WHOLE = "record_id string, kind string, target string, refers string, payload_bytes long, digest string, error string"


def whole(fields: dict[str, str], block: bytes, error: str | None = None) -> dict[str, object]:
    """A row of a whole record."""
    row: dict[str, object] = {"record_id": fields.get("warc-record-id"), "kind": fields.get("warc-type"), "target": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to"), "payload_bytes": None, "digest": None, "error": error}
    if error or row["kind"] not in ("response", "resource"):
        return row
    body = block
    try:
        if fields.get("content-type", "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            if "chunked" in header(head.decode("utf-8", "replace").split("\r\n")[1:]).get("transfer-encoding", "").lower():
                body = dechunked(body)
    except ValueError as e:
        return row | {"error": f"framing: {e}"}
    found, told = base32_sha1(body), fields.get("warc-payload-digest", "")
    if told.startswith("sha1:") and found != told[5:].upper():
        return row | {"error": "the payload does not have its digest"}
    return row | {"payload_bytes": len(body), "digest": found}


def joined(parts: dict[int, tuple[dict[str, str], bytes]]) -> dict[str, object]:
    """A row of a record from its segments by number."""
    total = parts[max(parts)][0].get("warc-segment-total-length", "")
    first = parts.get(1, parts[min(parts)])[0]
    block = b"".join(parts[k][1] for k in sorted(parts))
    if sorted(parts) != [*range(1, len(parts) + 1)] or total != str(len(block)):
        return whole(first, b"", "segments are missing or their length is not the total")
    return whole(first, block)


def read_file(content: bytes) -> Iterator[dict[str, object]]:
    """Rows of the records of an archive; segments of records that are not whole as such."""
    open_: dict[str, dict[int, tuple[dict[str, str], bytes]]] = {}
    try:
        for fields, block in parse(plain(content)):
            number = fields.get("warc-segment-number", "")
            if not number.isdecimal():
                yield whole(fields, block)
                continue
            origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id", "")
            parts = open_.setdefault(origin, {})
            parts[int(number)] = (fields, block)
            if "warc-segment-total-length" in parts[max(parts)][0] and max(parts) == len(parts):
                yield joined(open_.pop(origin))
    except (ValueError, EOFError, OSError, zlib.error) as e:
        yield whole({}, b"", f"archive: {e}")
    for origin, parts in open_.items():
        for k, (f, b) in parts.items():
            yield {"origin": origin, "number": k, "fields": list(f.items()), "block": b}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind, target, refers, payload_bytes, digest, error of each record in the archives below path, whoever wrote them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for row in read_file(content.as_py()):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {int(n): (dict(f), bytes(b)) for n, f, b in zip(pdf["number"], pdf["fields"], pdf["block"], strict=True)}
        return pd.DataFrame([joined(parts)]).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path).where("length > 0").select("content")
    with common.batches(spark, 1):  # a batch is a file
        found = common.stored(files.mapInArrow(run, f"{_WHOLE}, origin string, number int, fields map<string,string>, block binary"), "records")
    rest = found.where("origin is not null").groupBy("origin").applyInPandas(gather, _WHOLE)
    names = [n for n, _ in _FIELDS]
    return common.stored(found.where("origin is null").select(names).unionByName(rest.select(names)), "whole")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error of each page in the archives below path; page_id: out of identifiers that ``write_archives`` gives, else null."""
    rows = read_records(spark, path).where("kind is null or kind in ('response', 'revisit', 'resource')")
    page = lambda c: F.regexp_extract(c, "^<urn:page:([0-9-]+):", 1).try_cast("long")
    full = common.stored(rows.where("kind <> 'revisit'").select(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("b"), F.col("digest").alias("d"), page("record_id").alias("refers_to")), "responses")
    return rows.join(full, "refers", "left").select(
        page("record_id").alias("page_id"), F.coalesce("payload_bytes", "b").alias("payload_bytes"), F.coalesce("digest", "d").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "error"
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("error")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex,
         min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: translate(
         to_base(CAST('0x' || substr(hex, CAST(i AS BIGINT) * 5 + 1, 5) AS BIGINT), 32, 4), '{DIGITS[0]}', '{DIGITS[1]}')), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""
