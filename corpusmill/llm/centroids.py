"""Centroid clustering (Lloyd's rounds) by filtering kd-trees.

Vectors are quantised to integers, floor(scale * x). Each task builds kd-trees
over its own vectors, TREE_ROWS at most in each: a node has its count, the
integer sum of its vectors and their bounding box. The trees are written once.
A round sends every tree the centroids; from the root down, a centroid that is
strictly farther than another from every point of a node's box is pruned. A
node left with one centroid is assigned whole, by its count and sum; leaves
left with more are resolved by exact distances, the smaller number first among
equals. What a task returns is a count and a sum for each centroid, and what
the driver holds is the centroids. Everything is integer arithmetic.

Defined results
* null vectors, vectors of another length, with a null, NaN or infinite
  component: left out
* components beyond +-2^28 after quantisation: an error, as squared distances
  might leave 64 bits
* repeated rows: vectors of their own; ties: the smaller cluster number
* null id: kept; as a starting centroid it counts as an empty id
* fewer vectors than centroids: as many centroids as vectors; an empty table:
  an empty result
* a cluster that gets no vector keeps its centroid
* extra columns: never looked at
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors of a tree at most (half a megabyte at 64 dimensions of two bytes), and of a leaf.
TREE_ROWS = 4096
LEAF_ROWS = 32
#: Components beyond this might make a squared distance too large for 64 bits.
LARGEST = 1 << 28
#: Vectors that are compared with all centroids at once.
COMPARED = 4096


@dataclass
class Tree:
    """A complete binary tree: node k has the children 2k + 1 and 2k + 2, and holds points[start[k]:stop[k]]."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of some integer vectors, and the order that it puts them in: halves along the widest dimension, level by level."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF_ROWS)))))
    order = np.arange(n)
    cuts = np.array([0, n])
    starts, stops = [0], [n]
    for _ in range(depth):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                own = points[order[a:b]]
                wide = int(np.argmax(own.max(0) - own.min(0)))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], (b - a) // 2)]
        middle = (cuts[:-1] + cuts[1:]) // 2
        cuts = np.insert(cuts, np.arange(1, len(cuts)), middle)
        starts += cuts[:-1].tolist()
        stops += cuts[1:].tolist()
    points = points[order]
    # boxes and sums bottom up: leaves from their points, others from their children
    leaves = len(cuts) - 1
    low, high, total = (np.zeros((2 * leaves - 1, points.shape[1]), np.int64) for _ in range(3))
    first = leaves - 1
    low[first:], high[first:] = np.minimum.reduceat(points, cuts[:-1]), np.maximum.reduceat(points, cuts[:-1])
    total[first:] = np.add.reduceat(points, cuts[:-1])
    for k in range(first - 1, -1, -1):
        low[k], high[k] = np.minimum(low[2 * k + 1], low[2 * k + 2]), np.maximum(high[2 * k + 1], high[2 * k + 2])
        total[k] = total[2 * k + 1] + total[2 * k + 2]
    return Tree(points, np.array(starts), np.array(stops), low, high, total), order


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x centroids): products of doubles while every sum stays below 2^53, else of integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)).astype(np.int64)


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray | int, np.ndarray | None]]:
    """How a tree's vectors are assigned: (node, centroid, None) for a whole node, or (leaf, centroids of its vectors, their distances)."""
    k = len(centroids)
    leaves = (len(tree.start) + 1) // 2
    nodes, alive = np.array([0]), np.ones((1, k), bool)
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        # the nearest to the middle of the box, which the others have to be no farther from somewhere in it
        twice = low + high
        best = np.where(alive, distances(twice, 2 * centroids), np.iinfo(np.int64).max).argmin(1)
        for j in range(k):
            at = np.flatnonzero(alive[:, j] & (best != j))
            if not len(at):
                continue
            z, rival = centroids[best[at]], centroids[j]
            toward = rival - z
            corner = np.where(toward > 0, high[at], low[at])
            # |rival - corner|^2 - |z - corner|^2 at the corner that suits the rival best
            alive[at[(toward * (rival + z - 2 * corner)).sum(1) > 0], j] = False
        single = alive.sum(1) == 1
        for node, c in zip(nodes[single].tolist(), best[single].tolist(), strict=True):
            yield node, c, None
        at_leaf = ~single & (nodes >= leaves - 1)
        open_leaves = nodes[at_leaf]
        if len(open_leaves):
            size = tree.stop[open_leaves] - tree.start[open_leaves]
            rows = np.concatenate([np.arange(tree.start[n], tree.stop[n]) for n in open_leaves])
            d = np.where(np.repeat(alive[at_leaf], size, 0), distances(tree.points[rows], centroids), np.iinfo(np.int64).max)
            cluster = d.argmin(1)
            near = np.take_along_axis(d, cluster[:, None], 1)[:, 0]
            ends = np.cumsum(size)
            for n, a, b in zip(open_leaves.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                yield n, cluster[a:b], near[a:b]
        down = ~single & ~at_leaf
        nodes, alive = np.concatenate([2 * nodes[down] + 1, 2 * nodes[down] + 2]), np.concatenate([alive[down], alive[down]])


def _whole(vector: Column, dims: int) -> Column:
    return (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def _quantise(x: np.ndarray, scale: int) -> np.ndarray:
    q = np.floor(scale * x.astype(np.float64))
    if (np.abs(q) > LARGEST).any():
        raise ValueError("a component is beyond 2^28 after quantisation")
    return q.astype(np.int64)


_TREE = "ids array<long>, width int, rows int, points binary, start binary, stop binary, low binary, high binary, total binary"


def _trees(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """A row for each tree over the vectors (id, vector) of a task."""

    def row(ids: list[pa.Array], flat: list[np.ndarray]) -> pa.RecordBatch:
        points = _quantise(np.concatenate(flat), scale)
        tree, order = build(points)
        width = next(w for w, t in ((2, np.int16), (4, np.int32), (8, np.int64)) if np.abs(points).max() <= np.iinfo(t).max)
        whole = pa.concat_arrays(ids).take(pa.array(order))
        narrow = lambda a: a.astype(f"<i{width}").tobytes()
        values = [[whole.to_pylist()], [width], [len(points)], [narrow(tree.points)], [tree.start.astype("<i8").tobytes()], [tree.stop.astype("<i8").tobytes()], [narrow(tree.low)], [narrow(tree.high)], [tree.total.astype("<i8").tobytes()]]
        types = [pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in _TREE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        flat: list[np.ndarray] = []
        held = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                part = whole.slice(at, TREE_ROWS - held)
                ids.append(part.column(0).cast(pa.int64()))
                flat.append(part.column(1).flatten().to_numpy().reshape(-1, dims))
                held += part.num_rows
                at += part.num_rows
                if held == TREE_ROWS:
                    yield row(ids, flat)
                    ids, flat, held = [], [], 0
        if held:
            yield row(ids, flat)

    return vectors.mapInArrow(run, _TREE)


def _read(batch: pa.RecordBatch, k: int, dims: int) -> Tree:
    value = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()
    whole = lambda name, kind: np.frombuffer(value(name), kind).astype(np.int64)
    narrow = f"<i{value('width')}"
    boxes = [whole(c, kind).reshape(-1, dims) for c, kind in (("low", narrow), ("high", narrow), ("total", "<i8"))]
    return Tree(whole("points", narrow).reshape(-1, dims), whole("start", "<i8"), whole("stop", "<i8"), *boxes)


def _round(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one assignment of all vectors: floors of the means."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(shared.value, np.int64)
        count, total = np.zeros(len(c), np.int64), np.zeros_like(c)
        for batch in batches:
            for k in range(batch.num_rows):
                tree = _read(batch, k, dims)
                for node, cluster, near in filtered(tree, c):
                    a, b = tree.start[node], tree.stop[node]
                    if near is None:
                        count[cluster] += b - a
                        total[cluster] += tree.total[node]
                    else:
                        np.add.at(count, cluster, 1)
                        np.add.at(total, cluster, tree.points[a:b])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = [list(c) for c in centroids]
    # one row for each centroid
    for r in trees.mapInArrow(run, "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def _assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """id, cluster, distance of every vector."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(shared.value, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                tree = _read(batch, k, dims)
                cluster, distance = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), np.int64)
                for node, own, near in filtered(tree, c):
                    rows = slice(tree.start[node], tree.stop[node])
                    cluster[rows] = own
                    distance[rows] = ((tree.points[rows] - c[own]) ** 2).sum(1) if near is None else near
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).flatten(), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")


@dataclass
class Clusters:
    """assigned: id, cluster, distance; centroids: by cluster number."""

    assigned: DataFrame
    centroids: list[list[int]]


def cluster(vectors: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256, salt: str = "2:") -> Clusters:
    """Lloyd's rounds from the k vectors whose salted ids have the smallest hashes."""
    spark = vectors.sparkSession
    source = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    kept = source.where(_whole(F.col("vector"), dims))
    draw = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(draw.alias("draw"), "vector").orderBy("draw", "vector").limit(k).collect()
    if not first:
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), [])
    centroids = _quantise(np.array([r["vector"] for r in first]), scale).tolist()
    trees = common.stored(_trees(kept, dims, scale), "trees")
    for _ in range(rounds):
        centroids = _round(trees, centroids)
    return Clusters(_assigned(trees, centroids), centroids)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5)
    digest = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(found.centroids)]
    assigned = common.stored(found.assigned, "assigned")
    within = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # both have one row for each centroid
    told = within.join(F.broadcast(spark.createDataFrame(digest, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(within.agg(F.sum("cluster_inertia").alias("inertia"))))
    return assigned.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance in every round, one dimension a row."""
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "x AS (SELECT vec_id, unnest(range(1, 65)) AS d, unnest(q) AS x FROM v)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS (SELECT c, d, x AS z FROM f JOIN x USING (vec_id))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT vec_id, c, CAST(sum((x - z) * (x - z)) AS BIGINT) AS distance FROM x JOIN c{i} USING (d) GROUP BY vec_id, c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, c, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN x USING (vec_id) GROUP BY c, d)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, z) AS z FROM c{i} LEFT JOIN m{i} USING (c, d))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)"""


SQL = _sql()
