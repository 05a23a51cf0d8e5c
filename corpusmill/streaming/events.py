"""Streams over task events and uploaded files; every transformation also runs on a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources import places


def progress(events: DataFrame) -> DataFrame:
    """Counts of each task by event type, as they grow (update mode)."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, p: Params = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """Runs of a task's events with no gap of idle_seconds: a run that ends is one that timed out."""
    gap = F.session_window(F.col("ts").cast("timestamp"), f"{p.idle_seconds} seconds")
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", delay) if events.isStreaming else held
    return held.groupBy("user_id", gap.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def windows(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", delay) if events.isStreaming else held
    return held.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def first_uploads(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row of each (user_id, md5) while it is in flight."""
    if files.isStreaming:
        return files.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "md5"])
    return files.dropDuplicates(["user_id", "md5"])


def until_done(events: DataFrame) -> DataFrame:
    """events: (task_id, seq, event). Rows of each task up to its event ``done``."""
    end = events.where("event = 'done'").groupBy("task_id").agg(F.min("seq").alias("end"))
    return events.join(end, "task_id", "left").where(F.col("end").isNull() | (F.col("seq") <= F.col("end"))).drop("end")


def ingest_stream(spark: SparkSession, folder: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Runs sink over what is new in a folder of Parquet files, once for each batch, then stops."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All of a bounded stream, drained into a Parquet table: in append mode batch by batch, in complete mode the last state."""
    spark = stream.sparkSession
    path = places.fresh(spark, name)

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={n if mode == 'append' else 0}")

    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table").select(stream.columns)
