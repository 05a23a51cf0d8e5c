"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one task writes: rounds over few edges leave few files.
TASK_EDGES = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) long. Returns (node, component) for every node that is not the smallest of its component.

    Each round hangs every node on the smallest node that it can see; the
    edges of a node are never gathered, only their minimum is. Rounds grow
    with the logarithm of the largest component.

    Defined results: edges of a node with itself, and no edges at all, give no
    row; repeated and turned edges count once; nulls are not edges.
    """
    e = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = _digest(e)

    def kept(df: DataFrame, name: str) -> DataFrame:
        return common.stored(df.coalesce(2 * -(-seen[0] // TASK_EDGES)), name)

    while seen[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
        up = e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        large = kept(
            up.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(),
            "large",
        )
        lowest = kept(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = kept(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
