"""Sharding along a Hilbert curve.

Metadata dimensions (source, language, size) are quantised in their own order:
a value's bin is the share of rows with smaller values. A document's place is
the index of its cell on the curve through all cells, then a hash of its id.
Shards are runs of that order with counts at most one apart (the law
``rows``), so a shard spans few neighbouring values of every dimension and a
reader prunes whole files by any of them.

Values are ranked by counts over ranges of values, of which only the first
value of each bin reaches the driver, 32 a dimension at most. Global ranks come
from counts in a tree: cells on the curve (CELL_BITS bounds them, whatever the
number of dimensions), runs of buckets, buckets, rows. Buckets that rows with
one id fill beyond SPLIT rows are dealt to parts by a number of each row, so
no cell, id or null, however often it occurs, meets in one task.

Defined results
* null text: size 1, checksum of nothing; a null dimension: before all values
* null doc_id: hashes as the id ''
* equal texts, repeated rows: rows like any other; equal rows are interchangeable
* fewer rows than shards: the first shards hold one row each
* very long texts: measured whole; empty table: empty result
* extra or clashing columns: carried by ``write_shards``, never looked at
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS = 16
#: Bits of a dimension at most, and of all together, which bounds the cells.
BITS = 5
CELL_BITS = 15
#: Rows in a bucket on average, buckets in a run, and rows beyond which a bucket is dealt to parts.
BUCKET = 100
RUN = 1_000
SPLIT = 10_000


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with coordinates of so many bits."""
    x = [a.astype(np.int64).copy() for a in axes]
    for shift in range(bits - 1, 0, -1):
        q, p = 1 << shift, (1 << shift) - 1
        for i in range(len(x)):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(inside, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << shift)) != 0, (1 << shift) - 1, 0)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | ((a ^ turn) >> bit & 1)
    return index


def bins(values: DataFrame, bits: int) -> list[tuple[int, object]]:
    """(bin, its least value) in order, of a column ``v``: the bin of a value is the share of rows with smaller ones, in 2^bits steps."""
    counts = values.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = common.stored(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "values")
    # one row a range, as many as there are shuffle partitions
    sizes = ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    total = sum(r["n"] for r in sizes) + values.where("v is null").count()
    before, places = total - sum(r["n"] for r in sizes), []
    for r in sizes:
        places.append((r["range"], before))
        before += r["n"]
    offset = values.sparkSession.createDataFrame(places, "range int, offset long")
    inside = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    rows = ranged.join(F.broadcast(offset), "range").select("v", F.floor(place * (1 << bits) / max(1, total)).cast("int").alias("bin"))
    return [tuple(r) for r in rows.groupBy("bin").agg(F.min("v")).orderBy("bin").collect()]


def bin_of(value: Column, edges: list[tuple[int, object]]) -> Column:
    """The bin of a value; 0 for null."""
    out = F.lit(0)
    for k, least in edges:
        out = F.when(value >= F.lit(least), k).otherwise(out)
    return out


def _placed(docs: DataFrame, shards: int, text_col: str, id_col: str, dims: tuple[str, ...], carry: bool) -> tuple[DataFrame, DataFrame]:
    """The stored rows (u, row if carried), and (u, doc_id, size, text_crc32, cell, shard, slot) of each."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    axes = [*[F.col(f"row.`{c}`") for c in dims], size]
    bits = min(BITS, CELL_BITS // len(axes))
    quantised = [bin_of(a, bins(held.select(a.alias("v")), bits)).cast("long").alias(f"q{k}") for k, a in enumerate(axes)]

    def cell(*q: pd.Series) -> pd.Series:
        return pd.Series(hilbert([d.to_numpy() for d in q], bits))

    curve = F.pandas_udf(cell, T.LongType())
    narrow = held.select(
        *(["row"] if carry else []), F.col(f"row.`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("u"), *quantised
    ).withColumn("cell", curve(*[F.col(f"q{k}") for k in range(len(quantised))]))
    kept = common.stored(narrow.drop(*[f"q{k}" for k in range(len(quantised))]), "cells")
    d = kept.select("u", "doc_id", "size", "text_crc32", "cell")
    sum_before = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a cell, 2^CELL_BITS at most
    cells = common.stored(
        d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("in_all", sum_before(Window.partitionBy(F.lit(0)).orderBy("cell")))
        .withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET)).drop("n"),
        "curve",
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = d.join(F.broadcast(cells), "cell").withColumn("key", key)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("buckets"))).withColumn("run", F.expr(f"bucket div {RUN}"))
    full = common.stored(rows.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("cell", "bucket", F.ceil(F.col("n") / SPLIT).alias("parts")), "full")
    rows = rows.join(full, ["cell", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))))
    sums = common.stored(rows.groupBy("cell", "run", "bucket", "part").agg(F.count(F.lit(1)).alias("n")), "buckets")
    runs = common.stored(sums.groupBy("cell", "run").agg(F.sum("n").alias("n")).withColumn("in_cell", sum_before(Window.partitionBy("cell").orderBy("run"))).drop("n"), "runs")
    places = common.stored(
        sums.withColumn("in_run", sum_before(Window.partitionBy("cell", "run").orderBy("bucket", "part"))).join(runs, ["cell", "run"]).select("cell", "bucket", "part", (F.col("in_run") + F.col("in_cell")).alias("offset")),
        "places",
    )
    inside = Window.partitionBy("cell", "bucket", "part").orderBy("key", "doc_id", "text_crc32", "size", "u")
    ranked = rows.join(places, ["cell", "bucket", "part"]).withColumn("rank", F.col("in_all") + F.col("offset") + F.row_number().over(inside) - 1)
    least, more = F.expr(f"total div {shards}"), F.col("total") % shards
    in_more = F.col("rank") < more * (least + 1)
    shard = F.when(in_more, F.floor(F.col("rank") / (least + 1))).otherwise(more + F.floor((F.col("rank") - more * (least + 1)) / F.greatest(least, F.lit(1))))
    ranked = ranked.withColumn("shard", shard.cast("int"))
    first = F.col("shard") * least + F.least(F.col("shard").cast("long"), more)
    return kept, ranked.select("u", "doc_id", "size", "text_crc32", "cell", "shard", (F.col("rank") - first).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard, slot of each row of docs."""
    return _placed(docs, shards, text_col, id_col, dims, carry=False)[1].drop("u")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id", dims: tuple[str, ...] = ("source", "lang")) -> None:
    """Write the rows of docs, with all their columns, below path: a folder for each shard, in the order of slots.

    Rows meet their places by a number of their own, so ids may be null or
    repeated. The folders' column is ``shard``, or with as many underscores
    behind it as it takes where docs has that column; ``slot`` alike.
    """
    names = docs.columns
    free = {}
    for c in ("shard", "slot"):
        free[c] = c
        while free[c].lower() in {n.lower() for n in names}:
            free[c] += "_"
    kept, places = _placed(docs, shards, text_col, id_col, dims, carry=True)
    placed = kept.select("u", "row").join(places.select("u", "shard", "slot"), "u").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("shard").alias(free["shard"]), F.col("slot").alias(free["slot"])).write.partitionBy(free["shard"]).parquet(path)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
