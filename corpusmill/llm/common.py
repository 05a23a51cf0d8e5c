"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters that separate words in every contract of this subpackage.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one Arrow batch handed to Python, and bytes beyond which a
#: batch of longer texts ends; a single text may be longer.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


#: Bytes of input for each core below which a table in few files is dealt out anew.
SPREAD_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is small and in fewer files than cores is dealt out to all cores, as a file may be a single row group."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """The same for what is run inside; settings are as before afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    text_batches(spark, rows)
    try:
        yield
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def give_back() -> None:
    """Hand what this process has freed to the system. A worker waits for its next task for a minute, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives its memory back when the task has ended."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one of our own only where none is set and Spark runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="corpusmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Tables that are written between two collections of the driver's garbage.
COLLECT_EVERY = 6

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process. Call it once results have been written: plans read these tables until then."""
    for p in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.clear()


def collect_garbage(spark: SparkSession) -> None:
    """Plans, broadcasts and shuffles of steps that are over: Spark drops them when the driver collects its garbage, which a long row of small jobs puts off until the heap has grown to its limit."""
    gc.collect()  # what Python holds of the driver's objects
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: compressed, columnar, and safe against lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if len(_made) % COLLECT_EVERY == 0:
        collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_blanks(text: Column) -> Column:
    """The text with every blank removed. Chained byte replacements are several times faster than one regular expression."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sql_words(text: str) -> str:
    """DuckDB: the list of words of a text."""
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"
