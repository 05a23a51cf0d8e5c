"""Exact cosine search of many queries, tenant by tenant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .keyword import top

#: Queries up to which all go to every worker (at 1,024 dimensions 32 MB), and queries of a group beyond that.
QUERY_BLOCK = 4_096
#: Chunks in a group.
CHUNK_BLOCK = 20_000
#: Numbers that a product holds at once.
AT_ONCE = 8_000_000


def vector_topk(vectors: DataFrame, queries: DataFrame, p: Params = DEFAULT, threshold: float | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank: nearest chunks of the query's tenant.

    Up to QUERY_BLOCK queries are broadcast, and chunks pass workers in batches
    without a shuffle; each batch is one matrix product and keeps its own best k
    of each query, so what is shuffled grows with queries and batches, not with
    pairs. More queries meet the chunks in groups of a tenant's blocks: one
    scan of the chunks whatever the number of queries, nothing on the driver,
    and no tenant in one task. The threshold cuts after the k nearest are
    known; 0 turns it off, equality stays.
    """
    limit = p.distance_threshold if threshold is None else threshold
    q = queries.select("query_id", "user_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = q.limit(QUERY_BLOCK + 1).toPandas()
    found = _best_of_batches(vectors, asked, p.vector_k) if len(asked) <= QUERY_BLOCK else _best_of_groups(vectors, q, p.vector_k)
    best = top(found, F.asc(F.round("distance", 9)), p.vector_k)
    return best.where(F.col("distance") <= limit) if limit > 0 else best


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(ids: np.ndarray, q: np.ndarray, chunk: np.ndarray, v: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best chunks of each query by rounded distance, then chunk; q and v of unit length."""
    step = max(1, AT_ONCE // max(1, len(v)))
    by_chunk = np.argsort(chunk, kind="stable")
    chunk, v = chunk[by_chunk], v[by_chunk]
    for a in range(0, len(q), step):
        d = 1 - q[a : a + step] @ v.T
        if len(v) > k:
            least = np.partition(d, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(d <= least[:, None] + 1e-8)
        else:
            row, col = (x.ravel() for x in np.indices(d.shape))
        near = d[row, col]
        order = np.lexsort((col, np.round(near, 9), row))
        row, col, near = row[order], col[order], near[order]
        first = np.searchsorted(row, row, "left")
        keep = np.arange(len(row)) - first < k  # ties are cut by chunk
        yield pd.DataFrame({"query_id": ids[a : a + step][row[keep]], "chunk_id": chunk[col[keep]], "distance": near[keep]})


_FOUND = "query_id long, chunk_id long, distance double"


def _best_of_batches(vectors: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    by_user = {user: (rows["query_id"].to_numpy(), _unit(rows["embedding"])) for user, rows in asked.groupby("user_id")}
    shared = vectors.sparkSession.sparkContext.broadcast(by_user)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for user, rows in pdf.groupby("user_id"):
                if user in shared.value:
                    yield from nearest(*shared.value[user], rows["chunk_id"].to_numpy(), _unit(rows["embedding"]), k)

    return vectors.select("user_id", "chunk_id", "embedding").mapInPandas(run, _FOUND)


def _best_of_groups(vectors: DataFrame, q: DataFrame, k: int) -> DataFrame:
    number = lambda df, size, name: df.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = number(vectors.select("user_id"), CHUNK_BLOCK, "parts").join(number(q.select("user_id"), QUERY_BLOCK, "blocks"), "user_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    v = vectors.select("user_id", "chunk_id", "embedding").join(sizes, "user_id").withColumn("part", own("chunk_id", "parts")).withColumn("block", each("blocks")).drop("parts", "blocks")
    asked = q.join(sizes, "user_id").withColumn("block", own("query_id", "blocks")).withColumn("part", each("parts")).drop("parts", "blocks")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        return pd.concat(nearest(right["query_id"].to_numpy(), _unit(right["embedding"]), left["chunk_id"].to_numpy(), _unit(left["embedding"]), k))

    keys = ["user_id", "part", "block"]
    return v.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, _FOUND)
