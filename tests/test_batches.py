"""Python workers get texts in batches of bounded size, however large a partition is."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import chunking
from corpusmill.sources import loaders, tables

UNBOUND = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}


def unbound(spark):
    for name, value in UNBOUND.items():
        spark.conf.set(name, value)


def batches(rows):
    """Sizes of the batches of (text) that reach Python."""
    return [r["n"] for r in rows.coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int32())}) for b in bs), "n int").collect()]


def test_batches_of_documents(spark, tmp_path):
    unbound(spark)
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    for read in (tables.documents, tables.chunks):
        unbound(spark)
        sizes = batches(read(spark, str(tmp_path)).select("text"))
        assert sum(sizes) == 3000 and max(sizes) <= tables.BATCH_ROWS


def bounded(spark):
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= tables.BATCH_ROWS


def test_batches_of_files_and_archives(spark):
    files = spark.createDataFrame([("a.txt", "txt", b"x")], "path string, ext string, content binary")
    for read in (loaders.load_files, loaders.expand_archives):
        unbound(spark)
        read(files)
        assert bounded(spark)


def test_batches_of_pages_to_split(spark):
    unbound(spark)
    chunking.split_chunks(spark.createDataFrame([("u", "m", 1, "x")], "user_id string, md5 string, page int, text string"))
    assert bounded(spark)
