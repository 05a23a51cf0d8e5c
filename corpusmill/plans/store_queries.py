"""Queries of stores that change by versions, with the SQL that expresses what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import places, tables
from . import ingest


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk of its own, which is its text's fingerprint: user_id, md5, chunk_id, original_filename."""
    d = tables.documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("user_id"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"), "n_chars")
    return d.select("user_id", "md5", F.col("doc_id").alias("chunk_id"), F.concat(F.lit("f"), F.coalesce("n_chars", F.lit(0))).alias("original_filename"))


def _rows(files: DataFrame) -> DataFrame:
    return files.groupBy("user_id", "md5").agg(F.min("chunk_id").alias("first"))


def store_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in three uploads. The ledger rows of the second fail to be written; it comes again after the third, and the first is replayed in the end. Every document is there, as the first upload that had it brought it."""
    files = _files(spark, sf_dir)
    parts = [files.where(F.col("chunk_id") % 3 == k) for k in range(3)]
    store = ingest.open_store(spark, places.fresh(spark, "store"))
    first = ingest.record(store, parts[0], _rows(parts[0]))
    try:
        ingest.record(store, parts[1], _rows(parts[1]).withColumn("first", F.when(F.col("first") < 0, F.col("first")).otherwise(F.raise_error(F.lit("the ledger can't be written")).cast("long"))))
    except Exception as e:
        if "the ledger can't be written" not in str(e) or store.version() != first:
            raise
    for part in (parts[2], parts[1], parts[0]):
        ingest.record(store, part, _rows(part))
    chunks = store.read("chunks").groupBy("user_id", "md5").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("least"))
    return store.read("ledger").join(chunks, ["user_id", "md5"], "full").withColumn("versions", F.lit(store.version()).cast("long"))


def store_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are stored, then toxic ones and a tenant are deleted from chunks and ledger, documents of low quality come again under another name, and the chunks are compacted. n_old is what the version before the deletions still has."""
    files = _files(spark, sf_dir)
    store = ingest.open_store(spark, places.fresh(spark, "store"))
    whole = store.append({"chunks": files, "ledger": _rows(files)}, ranged=True)
    labelled = store.read("chunks").join(tables.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    ingest.remove(store, labelled.where("toxic = 1").select("user_id", "md5"))
    ingest.remove(store, spark.createDataFrame([("src1",)], "user_id string"))
    again = store.read("chunks").join(labelled.where("quality = 0").select("chunk_id"), "chunk_id", "left_semi")
    store.upsert("chunks", again.withColumn("original_filename", F.lit("again")), ["chunk_id"])
    store.compact("chunks")
    old = store.read("chunks", store.state(whole)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_old"))
    listed = store.read("ledger").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ledger"))
    now = store.read("chunks").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("original_filename") == "again").alias("n_again"), F.sum("chunk_id").alias("ids"))
    return old.join(now, "user_id", "left").join(listed, "user_id", "left").fillna(0)


QUERIES = {f.__name__: f for f in (store_uploads, store_deletions)}

_FILES = "f AS (SELECT coalesce(source, '') AS user_id, md5(coalesce(text, '')) AS md5, doc_id AS chunk_id, n_chars FROM documents)"
ORACLES = {
    "store_uploads": f"WITH {_FILES}, u AS (SELECT *, CASE chunk_id % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS came FROM f), k AS (SELECT *, min(came) OVER (PARTITION BY user_id, md5) AS one FROM u) "
    'SELECT user_id, md5, min(chunk_id) AS "first", count(*) AS n_chunks, min(chunk_id) AS least, CAST(3 AS BIGINT) AS versions FROM k WHERE came = one GROUP BY user_id, md5',
    "store_deletions": f"WITH {_FILES}, x AS (SELECT f.* FROM f ANTI JOIN (SELECT DISTINCT user_id, md5 FROM f JOIN labels ON doc_id = chunk_id WHERE toxic = 1) g USING (user_id, md5) WHERE user_id <> 'src1'), "
    "l AS (SELECT user_id, count(DISTINCT md5) AS n_ledger FROM x GROUP BY user_id), c AS (SELECT user_id, count(*) AS n_chunks, count_if(quality = 0)::BIGINT AS n_again, sum(chunk_id)::BIGINT AS ids FROM x LEFT JOIN labels ON doc_id = chunk_id GROUP BY user_id) "
    "SELECT user_id, o.n_old, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_again, 0) AS n_again, coalesce(ids, 0) AS ids, coalesce(n_ledger, 0) AS n_ledger "
    "FROM (SELECT user_id, count(*) AS n_old FROM f GROUP BY user_id) o LEFT JOIN c USING (user_id) LEFT JOIN l USING (user_id)",
}
