"""Queries of files, archives, ledgers and streams of uploads, made of the supplied tables, with the SQL that expresses them."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import management as mg
from ..sources import loaders, places, tables
from ..streaming import events as ev
from . import ingest


def loaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the content of a text file, or of one with an ending that no loader knows."""
    d = tables.documents(spark, sf_dir)
    files = d.select(F.concat(F.lit("d/"), "doc_id", F.when(F.col("doc_id") % 7 == 0, ".exe").otherwise(".txt")).alias("path"), F.when(F.col("doc_id") % 7 == 0, "exe").otherwise("txt").alias("ext"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return loaders.load_files(files).select("path", F.md5("text").alias("md5"), F.substring_index("error", ":", 1).alias("error"))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in an archive of its own, with a name that leads outside beside it; half of them are tar files."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                out, members = io.BytesIO(), {f"in/{doc_id}.txt": text.encode(), "../out.txt": b"x"}
                if doc_id % 2:
                    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as t:
                        for name, data in members.items():
                            info = tarfile.TarInfo(name)
                            info.size = len(data)
                            t.addfile(info, io.BytesIO(data))
                else:
                    with zipfile.ZipFile(out, "w") as z:
                        for name, data in members.items():
                            z.writestr(name, data)
                rows.append((f"a{doc_id}.{'tar.gz' if doc_id % 2 else 'zip'}", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    d = tables.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return loaders.expand_archives(d.mapInPandas(packed, "path string, content binary")).select("archive", "name", F.md5("content").alias("md5"), "error")


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a line of a ledger that also has blank and broken lines. what: read, or left of the raw lines when one fingerprint goes."""
    path = places.fresh(spark, "ledger")
    d = tables.documents(spark, sf_dir).select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    rows = d.select("md5", F.concat("doc_id", F.lit(".txt")).alias("filename"), F.concat("doc_id", F.lit(".txt")).alias("original_filename"), F.lit("2024-01-01T00:00:00").alias("upload_time"), F.col("source").alias("user_id"))
    loaders.append_ledger(rows, path)
    d.select(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("{broken "), "doc_id")).alias("value"), F.col("source").alias("user_id")).write.mode("append").partitionBy("user_id").text(path)
    read = loaders.read_ledger(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("md5").alias("n_md5")).withColumn("what", F.lit("read"))
    least = rows.agg(F.min("md5")).first()[0]
    left = loaders.delete_from_ledger(spark, path, least or "")
    kind = F.when(F.col("value").startswith("{broken"), "broken").when(F.col("value") == "", "blank").otherwise("kept")
    return read.unionByName(left.groupBy(kind.alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("user_id"), "n", F.lit(0).cast("long").alias("n_md5"), "what"))


def migrated_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of an old form, without a pin and with blank times, take the new columns."""
    m = tables.messages(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    old = m.select("session_id", F.when(F.col("n") % 2 == 0, "").when(F.col("n") % 3 == 0, "2024-02-02T00:00:00").alias("last_chat_time"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("n") % 60).cast("string"), 2, "0")).alias("created_at"))
    return mg.migrate(old, {"is_top": F.lit(0), "session_title": F.lit(""), "created_at": F.lit("never")})


def stream_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a stream that ends in a store; each batch is one transaction, and comes twice, as after a failure."""
    path = places.fresh(spark, "uploads")
    store = ingest.open_store(spark, f"{path}/store")

    def sink(batch: DataFrame, n: int) -> None:
        files = batch.select("user_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), "chunk_id")
        for _ in range(2):
            ingest.record(store, files, files.groupBy("user_id", "md5").agg(F.min("chunk_id").alias("first")), ("uploads", n))

    arriving = tables.chunks(spark, sf_dir).select("user_id", "chunk_id", "text")
    arriving.write.parquet(f"{path}/in")
    ev.ingest_stream(spark, f"{path}/in", arriving.schema, f"{path}/state", sink).awaitTermination()
    return store.read("chunks").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("md5").alias("n_md5")).join(store.read("ledger").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ledger")), "user_id")


QUERIES = {f.__name__: f for f in (loaded_files, archive_members, ledger_lines, migrated_conversations, stream_uploads)}

ORACLES = {
    "loaded_files": r"SELECT 'd/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.exe' ELSE '.txt' END AS path, CASE WHEN doc_id % 7 <> 0 AND regexp_matches(coalesce(text, ''), '[^\s]') THEN md5(text) END AS md5, "
    r"CASE WHEN doc_id % 7 = 0 OR NOT regexp_matches(coalesce(text, ''), '[^\s]') THEN 'ValueError' END AS error FROM documents",
    "archive_members": "SELECT 'a' || doc_id || CASE WHEN doc_id % 2 = 1 THEN '.tar.gz' ELSE '.zip' END AS archive, 'in/' || doc_id || '.txt' AS name, md5(coalesce(text, '')) AS md5, CAST(NULL AS VARCHAR) AS error FROM documents",
    "ledger_lines": "WITH d AS (SELECT doc_id, source AS user_id, md5(coalesce(text, '')) AS md5 FROM documents) SELECT user_id, count(*) AS n, count(DISTINCT md5) AS n_md5, 'read' AS what FROM d GROUP BY user_id "
    "UNION ALL SELECT '', count(*), 0, 'kept' FROM d WHERE md5 <> (SELECT min(md5) FROM d) UNION ALL SELECT '', count(*), 0, CASE WHEN doc_id % 2 = 0 THEN 'blank' ELSE 'broken' END FROM d GROUP BY 4",
    "migrated_conversations": "SELECT session_id, CASE WHEN n % 2 = 0 THEN created_at WHEN n % 3 = 0 THEN '2024-02-02T00:00:00' ELSE created_at END AS last_chat_time, created_at, 0 AS is_top, '' AS session_title "
    "FROM (SELECT conv_id AS session_id, count(*) AS n, printf('2024-01-01T00:00:%02d', count(*) % 60) AS created_at FROM conversations GROUP BY conv_id)",
    "stream_uploads": "SELECT source AS user_id, count(*) AS n, count(DISTINCT md5(coalesce(text, ''))) AS n_md5, count(DISTINCT md5(coalesce(text, ''))) AS n_ledger FROM documents GROUP BY source",
}
