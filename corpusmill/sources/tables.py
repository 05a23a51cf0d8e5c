"""Readers of the supplied tables under the names that the engine uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts in one Arrow batch handed to Python, and bytes beyond which a batch of longer texts ends; a single text may be longer.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers, so that what a worker holds doesn't depend on the table. For the session, as plans run later."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))


#: Bytes of input for each core below which a table is dealt out anew.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that is small for the cores is dealt out to all of them: its file may be one row group, which one task reads. Larger ones stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on whole texts."""
    text_batches(spark)
    return spread(table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of their tenants: user_id, chunk_id, text."""
    text_batches(spark)
    return spread(table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("chunk_id"), "text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks with their tenant; text columns are never read."""
    owner = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("user_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(owner, "chunk_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query of one of the tenants."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("user_id"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as stored messages: session_id, id, type, content."""
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), role.alias("type"), F.col("text").alias("content"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
