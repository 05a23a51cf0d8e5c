"""Exact cosine search over cells of vectors, of which most need not be looked at.

Angles between vectors obey the triangle inequality. Vectors are dealt to the
nearest of some pivots; those of a tenant and pivot, ordered by their angle to
it, are its cells. A query within an angle a of the pivot is at least as far
from a vector as a and the vector's own angle differ. So a query is compared
with the cells of the least bound first, until they have k vectors; the k-th
angle found then excludes cells, and vectors of the cells that are left.

Defined results
* null vectors: never found, and as queries without results; zero vectors:
  at distance 1 of everything
* tenants without vectors, and empty tables: no rows
* fewer than k vectors: all; ties: the smaller chunk id
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources import places
from .keyword import top
from .vector import _unit, nearest

#: Pivots at most (at 1,024 dimensions 2 MB), and vectors for each below that.
PIVOTS = 256
PIVOT_ROWS = 1_000
#: Vectors of a range that is ordered by tenant, pivot and angle; a cell lies within one.
RANGE_ROWS = 20_000
#: Angles within this count as equal.
EDGE = 1e-7
_VECTOR = "user_id string, chunk_id long, pivot int, angle double, unit array<double>"
_PAIR = ["user_id", "pivot", "part"]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1)) if len(b) else np.zeros((len(a), 0))


def write_cells(vectors: DataFrame, path: str, pivots: int | None = None) -> None:
    """Deal vectors (user_id, chunk_id, embedding) to cells below a path: the vectors of least hash are pivots."""
    spark = vectors.sparkSession
    some = vectors.where("embedding is not null")
    pivots = pivots or min(PIVOTS, 4 + some.count() // PIVOT_ROWS)
    drawn = some.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).select(F.col("embedding").cast("array<double>").alias("embedding")).toPandas()
    centre = _unit(drawn["embedding"]) if len(drawn) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centre)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(pdf["embedding"])
                angle = _angles(unit, shared.value)
                own = angle.argmin(1)
                yield pd.DataFrame({"user_id": pdf["user_id"], "chunk_id": pdf["chunk_id"], "pivot": own, "angle": angle[np.arange(len(own)), own], "unit": list(unit)})

    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centre)], "pivot int, centre array<double>").write.parquet(f"{path}/pivots")
    dealt = some.select("user_id", "chunk_id", "embedding").mapInPandas(run, _VECTOR)
    dealt.write.parquet(f"{path}/dealt")
    dealt = spark.read.schema(_VECTOR).parquet(f"{path}/dealt")
    ranges = max(1, -(-dealt.count() // RANGE_ROWS))
    ordered = dealt.repartitionByRange(ranges, "user_id", "pivot", "angle").sortWithinPartitions("user_id", "pivot", "angle")
    ordered.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors")
    held.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).write.parquet(f"{path}/cells")


def _asked(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id, user_id, unit, angles to all pivots."""
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").toPandas()
    shared = spark.sparkContext.broadcast(np.stack(pivots["centre"].to_numpy()) if len(pivots) else np.zeros((0, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(pdf["embedding"])
                yield pd.DataFrame({"query_id": pdf["query_id"], "user_id": pdf["user_id"], "unit": list(unit), "angles": list(_angles(unit, shared.value))})

    rows = queries.where("embedding is not null").select("query_id", "user_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return _stored(rows.mapInPandas(run, "query_id long, user_id string, unit array<double>, angles array<double>"), "asked")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = places.fresh(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _compared(vectors: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance, compared: the best k of each cell for each query that has to see it, of the vectors within the reach of the pair; compared: in one more row of the cell, the pairs that this took, elsewhere -1."""

    def run(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        found, n = [], 0
        if len(own) and len(seen):
            own = own.sort_values("angle", kind="stable")
            angle, chunk, unit = own["angle"].to_numpy(), own["chunk_id"].to_numpy(), np.stack(own["unit"].to_numpy())
            lo = np.searchsorted(angle, (seen["angle"] - seen["reach"]).to_numpy(), "left")
            hi = np.searchsorted(angle, (seen["angle"] + seen["reach"]).to_numpy(), "right")
            for a, b, row in zip(lo.tolist(), hi.tolist(), range(len(seen)), strict=True):
                if b > a:
                    n += b - a
                    found += nearest(seen["query_id"].to_numpy()[row : row + 1], seen["unit"].iloc[row][None, :], chunk[a:b], unit[a:b], k)
        rows = [pd.DataFrame({"query_id": [-1], "chunk_id": [-1], "distance": [0.0], "compared": [n]})]
        return pd.concat([*(f.assign(compared=-1) for f in found), *rows])

    seen = pairs.join(asked.select("query_id", "unit"), "query_id")
    return vectors.groupBy(*_PAIR).cogroup(seen.groupBy(*_PAIR)).applyInPandas(run, "query_id long, chunk_id long, distance double, compared long")


def cells_topk(spark: SparkSession, path: str, queries: DataFrame, p: Params = DEFAULT, threshold: float | None = None, told: dict | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank: what vector_topk finds. queries: (query_id, user_id, embedding). told takes the number of pairs of a query and a vector of its tenant, and of those compared."""
    limit = p.distance_threshold if threshold is None else threshold
    asked, vectors, cells = _asked(spark, path, queries), spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells")
    pairs = cells.join(asked.select("query_id", "user_id", "angles"), "user_id").withColumn("angle", F.expr("angles[pivot]")).drop("angles")
    pairs = _stored(pairs.withColumn("bound", F.greatest(F.lit(0.0), F.col("angle") - F.col("high"), F.col("low") - F.col("angle"))), "pairs")
    nearest_first = Window.partitionBy("query_id").orderBy("bound", "angle", *_PAIR)
    upto = F.sum("n").over(nearest_first.rowsBetween(Window.unboundedPreceding, 0))
    first = _stored(pairs.withColumn("upto", upto).where(F.col("upto") - F.col("n") < p.vector_k).select("query_id", *_PAIR, "angle", F.lit(4.0).alias("reach")), "first")
    begun = _stored(_compared(vectors, asked, first, p.vector_k), "begun")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    reach = begun.where("compared < 0").withColumn("place", place).where(F.col("place") == p.vector_k)
    reach = reach.select("query_id", (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))) + EDGE + F.sqrt(F.lit(4e-9))).alias("reach"))
    rest = pairs.join(first, ["query_id", *_PAIR], "left_anti").join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(4.0)))
    rest = _stored(_compared(vectors, asked, rest.where(F.col("bound") <= F.col("reach")).select("query_id", *_PAIR, "angle", "reach"), p.vector_k), "rest")
    both = begun.unionByName(rest)
    if told is not None:
        told |= {"pairs": pairs.agg(F.sum("n")).first()[0] or 0, "compared": both.where("compared >= 0").agg(F.sum("compared")).first()[0] or 0}
    best = top(both.where("compared < 0").select("query_id", "chunk_id", "distance"), F.asc(F.round("distance", 9)), p.vector_k)
    return best.where(F.col("distance") <= limit) if limit > 0 else best
