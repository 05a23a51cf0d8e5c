"""Checks of uploads, fingerprints, and reasons of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

# First bytes of files in hex, with the status they mean. As stored bytes, not as text.
MAGIC = (("25504446", "parse_error"), ("89504E47", "unsupported_format"), ("FFD8FF", "unsupported_format"), ("47494638", "unsupported_format"), ("D0CF11E0", "unsupported_format"))
# What marks the error of a loader that is worth telling, in order.
LOADER_ERRORS = (
    r"视觉服务.*(?:超时|描述失败)",
    r"未安装|ImportError|ModuleNotFoundError|No module named",
    r"不支持的文件格式|格式不支持",
    r"解析结果为空|提取结果为空|加载内容为空",
    r"无法打开|已加密|密码",
    r"pdfplumber|PyMuPDF|fitz|PaddleOCR|opencv",
)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def archive_allowed(name: Column) -> Column:
    low = F.lower(name)
    return low.endswith(".zip") | low.endswith(".tar.gz")


def member_allowed(name: Column, p: Params = DEFAULT, exact_case: bool = False) -> Column:
    ext = F.regexp_extract(name, r"\.([^./]*)$", 1)
    return (ext if exact_case else F.lower(ext)).isin(*p.file_types)


def validate(name: Column, size: Column, p: Params = DEFAULT) -> Column:
    """ok, or why an upload is refused."""
    return F.when(size > p.max_file_bytes, "size_exceeded").when(~member_allowed(name, p), "unsupported_format").otherwise("ok")


def archive_fits(members: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """members: (archive_id, name, size). archive_id, n_valid, n_skipped, bytes of the allowed ones, fits."""
    ok = member_allowed(F.col("name"), p)
    out = members.groupBy("archive_id").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_skipped"), F.sum(F.when(ok, F.col("size")).otherwise(0)).alias("bytes"))
    return out.withColumn("fits", F.col("bytes") <= p.max_expanded_bytes)


# First bytes of files in hex, with their media type.
MEDIA = (("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("D0CF11E0", "application/x-ole-storage"))
#: Bytes of a file that its media type is told by.
SNIFFED = 2048


def media_type(content_hex: Column) -> Column:
    """The media type by the first SNIFFED bytes, given as upper-case hex: a guess that is stored with the upload and refuses none."""
    head = F.substring(content_hex, 1, 2 * SNIFFED)
    out = F.when(F.coalesce(F.length(head), F.lit(0)) == 0, "application/x-empty")
    for first, kind in MEDIA:
        out = out.when(head.startswith(first), kind)
    return out.when(F.regexp_replace(head, "(..)", "$1 ").contains("00 "), "application/octet-stream").otherwise("text/plain")


def diagnose(content_hex: Column) -> Column:
    """Status by the first bytes, given as upper-case hex of the content's beginning."""
    out = F.when(F.length(content_hex) == 0, "empty_file")
    for head, status in MAGIC:
        out = out.when(content_hex.startswith(head), status)
    return out.otherwise("unknown_format")


def loader_error(errors: Column) -> Column:
    """The first error that any of the marks fits; empty if none."""
    fits = lambda e: F.coalesce(F.array_max(F.array(*[e.rlike(m) for m in LOADER_ERRORS])), F.lit(False))
    return F.coalesce(F.get(F.filter(errors, fits), 0), F.lit(""))


def classify_error(status: Column, reason: Column) -> Column:
    low = F.lower(reason)
    return (
        F.when(status == "duplicate", "duplicate")
        .when(F.contains(low, F.lit("empty")) | F.contains(reason, F.lit("空")), "empty_content")
        .when(F.contains(low, F.lit("size")) | F.contains(reason, F.lit("过大")), "size_exceeded")
        .otherwise("parse_failed")
    )


def fingerprint(files: DataFrame, per_user: bool = True) -> DataFrame:
    """files: (user_id, file_id, text). Adds md5 and whether an earlier file of the same tenant (or of all) has it."""
    keyed = files.withColumn("md5", F.md5("text"))
    keys = ["user_id", "md5"] if per_user else ["md5"]
    first = keyed.groupBy(*keys).agg(F.min("file_id").alias("first_id"))
    return keyed.join(first, keys).withColumn("duplicate", F.col("file_id") != F.col("first_id"))


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose (user_id, md5) the ledger does not have, the first of each."""
    w = Window.partitionBy("user_id", "md5").orderBy("file_id")
    fresh = files.join(ledger, ["user_id", "md5"], "left_anti")
    return fresh.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
