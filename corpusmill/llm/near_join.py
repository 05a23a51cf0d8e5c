"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles. Equal sets are one node. All
shingles stand in one order, rare before common by a count sketch of the whole
corpus. Two sets that are similar enough share at least m of their first
n - ceil(t n) + m shingles, for any m; each document takes the m whose prefix
has the least estimated cost, longer prefixes demanding more shared shingles.

Where at most SMALL nodes share a prefix shingle, their pairs are counted and
those that may share enough shingles are verified. Pairs that share none of
these need m shingles of more nodes each: nodes that have so many form
clusters. Small clusters are one block that is verified inside a worker, which
returns the edges of a spanning forest only, never all pairs. In large ones
all nodes are compared with some pivots; most hang on one and are joined.
Jaccard distances obey the triangle inequality, so a node apart from these can
be similar only to nodes of pivots within twice the distance, and is compared
with those; the nodes apart form the clusters of the next turn. Nothing is
capped: all ways together cover every pair that can be similar.

Defined results
* null, empty and blank texts: no shingle, linked with nothing
* fewer words than a shingle has: the whole sequence is the only shingle
* very long texts: whole
* ids are whole numbers, others fail; rows with the same id: one document;
  for ``drop_near_copies`` ids may be of any type, and rows are documents
* null id: linked with nothing, null component
* empty table: empty result
* extra or clashing columns: carried by ``drop_near_copies``, never looked at
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .shingles import mix, sets

#: Nodes around a shingle up to which their pairs are counted one by one.
SMALL = 16
#: Nodes in a block of a cluster; a cluster of more has pivots.
BLOCK = 120
#: Pivots of a cluster, and bytes of their sets, at most; nodes, and bytes of their sets, that are compared with them in one group; turns with pivots.
PIVOTS = 64
PIVOT_BYTES = 4 << 20
GROUP_NODES = 400
GROUP_BYTES = 16 << 20
TURNS = 6
#: Bytes of sets that are dealt to pairs of blocks at once: what is more goes in waves, the shuffle of each dropped before the next.
WAVE_BYTES = 4 << 30
#: Documents by the sketch from which on a shingle counts as one of many nodes unseen, and parts that its postings are dealt to.
HOT = 5_000
HOT_PARTS = 64
#: Shingles whose owners are compared at once.
RANGE_SHINGLES = 400_000
MAX_MATCHES = 8
#: Counters of the sketch: 2^16 to 2^24 (64 MB), about one for 64 shingles.
SKETCH_BITS = (16, 24)
SKETCH_PARTS = 16
FAN_IN = 32
#: Bits of the filter that tells which texts to hash again, 1 MB; false hits only cost time.
FILTER_BITS = 23
#: Columns of prefixes.
PREFIX = "doc_id long, m int, tokens binary, hot binary"
#: Bits of the set of shingles that a first look found around many nodes, 2 MB; false hits only change the order, for all documents alike.
KNOWN_BITS = 24


def required(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def _source(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def _heads(source: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows of two kinds from one pass: the set of each document (n, s1, s2), and in the end the parts of each task's sketch."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            n, s1, s2 = [], [], []
            for u in sets(batch.column(1), words):
                n.append(len(u))
                s1.append(int(mix(u).sum(dtype=np.uint64)))
                s2.append(int(np.bitwise_xor.reduce(mix(u + np.uint64(0x5851F42D4C957F2D)))) if len(u) else 0)
                np.add.at(sketch, (u >> np.uint64(64 - bits)).astype(np.int64), 1)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                ["doc_id", "n", "s1", "s2", "part", "salt", "counts"],
            )
        if sketch.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in sketch.reshape(SKETCH_PARTS, -1)]
            k, salt = SKETCH_PARTS, int(sketch[: 1 << 10].sum()) % FAN_IN
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(k, pa.int64())] * 4, pa.array(range(k), pa.int32()), pa.array([salt] * k, pa.int32()), pa.array(parts, pa.binary())],
                ["doc_id", "n", "s1", "s2", "part", "salt", "counts"],
            )

    return source.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, part int, salt int, counts binary")


def _sum_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    kind = "part int, salt int, counts binary"

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << bits) // SKETCH_PARTS, np.uint32)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pd.DataFrame({"part": [key[0]], "salt": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = parts.groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind).collect()
    out = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint32)
    for r in rows:
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out.ravel()


def choose_prefix(excess: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(matches, prefix length) with the least estimated cost; excess: by shingle in order, how often beyond chance it occurs."""
    least = required(n, percent)
    most = min(MAX_MATCHES, least)
    total = np.cumsum(excess[: n - least + most])
    m = np.arange(1, most + 1)
    size = n - least + m
    cost = size + total[size - 1] + 8 * (2 * size + total[size - 1]) / (m * m)
    best = int(np.argmin(cost))
    return best + 1, int(size[best])


def _prefixes_of(own: Callable[[pa.Array], Iterator[np.ndarray]], percent: int, sketch, bits: int, known=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a worker makes of batches of documents for ``_prefixes``; own: the sets of their second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value.astype(np.float32)
        usual = float(np.median(counts))
        bound = usual + 3 * usual**0.5 + 2
        level = np.where(counts > bound, 1 + (4 * np.log2(np.maximum(counts, 1) / bound)).astype(np.int64), 0).astype(np.uint8)
        excess = np.where(counts > bound, counts - usual, 0)
        for batch in batches:
            m, tokens, hot = [], [], []
            for u in own(batch.column(1)):
                if not len(u):
                    m.append(0)
                    tokens.append(b"")
                    hot.append(b"")
                    continue
                at = (u >> np.uint64(64 - bits)).astype(np.int64)
                lv, beyond = level[at], excess[at]
                if known is not None:
                    bit = (u & np.uint64((1 << KNOWN_BITS) - 1)).astype(np.int64)
                    many = known.value[bit >> 6] >> (bit & 63) & 1
                    lv, beyond = np.maximum(lv, many), np.maximum(beyond, many * SMALL)
                if lv.any():
                    order = np.lexsort((u, lv))
                    u, at, beyond = u[order], at[order], beyond[order]
                k, size = choose_prefix(beyond, len(u), percent)
                m.append(k)
                tokens.append(u[:size].tobytes())
                hot.append((counts[at[:size]] > HOT).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(m, pa.int32()), pa.array(tokens, pa.binary()), pa.array(hot, pa.binary())], ["doc_id", "m", "tokens", "hot"])

    return run


def _prefixes(source: DataFrame, words: int, percent: int, sketch, bits: int, known=None) -> DataFrame:
    """doc_id, m, tokens, hot: the prefix of each document as packed hashes, and as a byte each if the shingle is in very many documents. Shingles that are known to be crowded come behind those that the sketch takes for rare."""
    return source.mapInArrow(common.tidy(_prefixes_of(partial(sets, words=words), percent, sketch, bits, known)), PREFIX)


def _crowded(source: DataFrame, words: int, percent: int, sketch, bits: int) -> np.ndarray:
    """A bit for each shingle that is in the prefixes of many documents, of fixed size. The sketch can't tell these from rare ones once its counters hold many shingles each; unrelated texts would meet in them."""
    prefixes = _prefixes_of(partial(sets, words=words), percent, sketch, bits)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in the worker that finds the prefixes: a second one beside it would stay for as long as the stages go on
        for batch in prefixes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64))], ["token"])

    many = source.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") > SMALL)
    return _bits(many.select(F.col("token").bitwiseAND(F.lit((1 << KNOWN_BITS) - 1)).alias("bit")), KNOWN_BITS)


def _postings(prefixes: DataFrame) -> DataFrame:
    """token, node, m, part: one row for each shingle of each prefix; part: from 1 on for shingles in very many documents, else 0."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, hot = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size = np.fromiter((len(t) // 8 for t in tokens), np.int64, len(tokens))
            node = np.repeat(batch.column(0).to_numpy(), size)
            part = np.where(np.frombuffer(b"".join(hot), bool), 1 + mix(node.view(np.uint64)) % np.uint64(HOT_PARTS), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(tokens), np.int64)), pa.array(node), pa.array(np.repeat(batch.column(1).to_numpy(), size)), pa.array(part)], ["token", "node", "m", "part"])

    return prefixes.mapInArrow(run, "token long, node long, m int, part int")


def _meetings(postings: DataFrame) -> DataFrame:
    """(kind, a, b, m) out of postings sorted by token: kind 0 are the pairs around a shingle of few nodes, kind 1 the postings (a: token, b: node) of a shingle of many."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(m)], ["kind", "a", "b", "m"])

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        hot: int | None = None  # token of many nodes that the last batch ended with

        def meet(token: np.ndarray, node: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(token):
                return
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[first, len(token)])
            of = np.repeat(size, size)
            for d in range(1, min(SMALL, int(size.max()))):
                i = np.flatnonzero((token[d:] == token[:-d]) & (of[d:] <= SMALL) & (node[d:] != node[:-d]))
                if len(i):
                    a, b = node[i], node[i + d]
                    yield rows(0, np.minimum(a, b), np.maximum(a, b), np.minimum(m[i], m[i + d]))
            many = np.flatnonzero(of > SMALL)
            if len(many):
                yield rows(1, token[many], node[many], m[many])

        for batch in batches:
            token, node, m, part = (batch.column(k).to_numpy() for k in range(4))
            if part.any():
                yield rows(1, token[part > 0], node[part > 0], m[part > 0])
                token, node, m = token[part == 0], node[part == 0], m[part == 0]
                if not len(token):
                    continue
            if hot is not None:
                n = int(np.searchsorted(token, hot, "right"))
                if n:
                    yield rows(1, token[:n], node[:n], m[:n])
                if n == len(token):
                    continue
                hot, token, node, m = None, token[n:], node[n:], m[n:]
            token, node, m = (np.concatenate(x) for x in zip(held, (token, node, m), strict=True))
            held = (token[:0], node[:0], m[:0])
            if not len(token):
                continue
            last = int(np.searchsorted(token, token[-1], "left"))
            if len(token) - last > SMALL:
                hot = int(token[-1])
                yield from meet(token, node, m)
            else:
                held = (token[last:], node[last:], m[last:])
                yield from meet(token[:last], node[:last], m[:last])
        yield from meet(*held)

    near = postings.repartition("token", "part").sortWithinPartitions("token", "node")
    return near.mapInArrow(run, "kind int, a long, b long, m int")


def _around_many(postings: DataFrame, many: DataFrame) -> DataFrame:
    """(a, b): star edges between nodes that may share enough of the shingles of many nodes alone.

    postings: (token, node, m); many: (node, h), the number of such shingles
    of a node. A pair without a shingle of few nodes in common needs at least
    min(m, m') of them on both sides, so a node with fewer than its own m, and
    than the least m around its shingles, has no such partner. Of h shingles,
    in one order for all, the first shared one is among the first h - m + 1
    on both sides; those of the fewest nodes come first.
    """
    around = common.stored(postings.groupBy("token").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("df")), "around")
    own = postings.join(around, "token").join(many, "node")
    need = Window.partitionBy("node")
    own = own.withColumn("need", F.least(F.min("m").over(need), F.min("least").over(need))).where("h >= need")
    own = own.withColumn("rank", F.row_number().over(need.orderBy("df", "token"))).where(F.col("rank") <= F.col("h") - F.col("need") + 1)
    able = common.stored(own.select("token", "node"), "able")
    first = common.stored(able.groupBy("token").agg(F.min("node").alias("a")), "first")
    return able.join(first, "token").select("a", F.col("node").alias("b")).where("a <> b")


def _met(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the pairs around shingles of few nodes that may share enough of all, and (node, cluster) of the nodes that may share enough of those of many alone."""
    met = common.stored(_meetings(postings).groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m")), "met")
    crowded = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "m")
    many = common.stored(crowded.groupBy("node").agg(F.count(F.lit(1)).alias("h")), "many")
    # shared shingles of few nodes, and at most so many of many nodes
    bound = F.col("n") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = met.where("kind = 0").join(many.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a", "left").join(many.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b", "left")
    clusters = connected_components(_around_many(crowded, many))
    members = common.stored(clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()), "members").withColumnRenamed("component", "cluster")
    return pairs.where(bound >= F.col("m")).select("a", "b"), members


def _bits(numbers: DataFrame, bits: int) -> np.ndarray:
    """The set of the numbers (bit) below 2^bits, a bit for each."""
    rows = numbers.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit for each hash of a node, of fixed size."""
    return _bits(nodes.select(F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS)).alias("bit")), FILTER_BITS)


def _sets_of(source: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, grams: the sets of the nodes, hashed again from their texts, so that sets are never moved but for nodes that need them."""
    spark = source.sparkSession
    bits = spark.sparkContext.broadcast(_filter_of(nodes))
    marked = source.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bits.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((own[bit >> 6] >> (bit & 63) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in sets(batch.column(1), words)], pa.binary())], ["node", "grams"])

    return marked.mapInArrow(run, "node long, grams binary").join(nodes, "node", "left_semi")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, x, y) whose sets x and y are similar enough."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v)) if min(len(u), len(v)) >= required(max(len(u), len(v)), percent) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks: products of slices of the membership matrix, ranges of hashes one after the other."""
    n = len(grams)
    both = np.zeros((n, n), np.float32)
    parts = 1 + sum(map(len, grams)) // RANGE_SHINGLES
    edges = [k * (1 << 64) // parts for k in range(parts)]
    cuts = [np.r_[np.searchsorted(g, np.array(edges, np.uint64)), len(g)] for g in grams]
    for k in range(parts):
        own = [g[c[k] : c[k + 1]] for g, c in zip(grams, cuts, strict=True)]
        owner = np.repeat(np.arange(n), [len(g) for g in own])
        if not len(owner):
            continue
        _, token, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = df[token] > 1
        owner, token = owner[shared], (np.cumsum(df > 1) - 1)[token[shared]]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        for c in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            lo, hi = np.searchsorted(token, [c, c + 4096])
            dense = np.zeros((n, 4096), np.float32)
            dense[owner[lo:hi], token[lo:hi] - c] = 1
            both += dense @ dense.T
    return both


def forest(node: np.ndarray, side: np.ndarray, grams: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The edges of a spanning forest of the similar pairs, of which the sides differ if there are two."""
    n = len(node)
    size = np.array([len(g) for g in grams])
    both = _overlaps(grams)
    union = size[:, None] + size[None, :] - both
    similar = (both > 0) & (100 * both >= percent * union)
    if (side != side[0]).any():
        similar &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((int(node[i]), int(node[j])))
    return edges


def _in_blocks(members: DataFrame, sizes: DataFrame, percent: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """(a, b): a spanning forest of every two blocks of every cluster, of those that are in this wave; members: (node, cluster, grams), sizes: (cluster, size)."""
    blocks = members.join(sizes.select("cluster", "size"), "cluster").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = blocks.select("cluster", "node", "own", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    if waves > 1:
        dealt = dealt.where((F.col("i") + F.col("j")) % waves == wave)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = forest(pdf["node"].to_numpy(), pdf["own"].to_numpy(), [np.frombuffer(g, np.uint64) for g in pdf["grams"]], percent)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def compare(grams: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(similar, near) of each set and pivot; near: within twice the distance, so that a set similar to the pivot may be similar to it."""
    tokens, at = np.unique(np.concatenate(pivots), return_inverse=True)
    has = np.zeros((len(tokens), len(pivots)), np.uint8)
    has[at, np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])] = 1
    both = np.zeros((len(grams), len(pivots)), np.int64)
    for k, g in enumerate(grams):
        found = np.minimum(np.searchsorted(tokens, g), len(tokens) - 1)
        both[k] = has[found[tokens[found] == g]].sum(0, dtype=np.int64)
    union = np.array([len(g) for g in grams])[:, None] + np.array([len(p) for p in pivots]) - both
    return 100 * both >= percent * union, 100 * both >= (2 * percent - 100) * union


def main_component(pdf: pd.DataFrame) -> tuple[dict[int, int], set[int], list[tuple[int, int]]]:
    """Of rows (what, x, y) of a cluster, what 0: pivot x is node y, 1: y nodes hang on pivot x, 2: a node is similar to pivots x and y.

    Returns the node of each pivot, the pivots of the component with the most nodes, and the edges between pivots' nodes.
    """
    of = [list(zip(*(pdf.loc[pdf["what"] == w, c].tolist() for c in ("x", "y")), strict=True)) for w in (0, 1, 2)]
    node, hang = dict(of[0]), dict(of[1])
    root = {x: x for x in node}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x, y in of[2]:
        root[max(find(x), find(y))] = min(find(x), find(y))
    total: dict[int, int] = {}
    for x in node:
        total[find(x)] = total.get(find(x), 0) + hang.get(x, 0)
    best = min(total, key=lambda r: (-total[r], r))
    return node, {x for x in node if find(x) == best}, [(node[x], node[y]) for x, y in of[2]]


def _around_pivots(members: DataFrame, sizes: DataFrame, percent: int, turn: int) -> tuple[list[DataFrame], DataFrame]:
    """One turn over large clusters: edges (a, b), and the members that are left to be compared with each other."""
    groups = sizes.withColumn("parts", F.ceil(F.greatest(F.col("bytes") / GROUP_BYTES, F.col("size") / GROUP_NODES)).cast("int")).select("cluster", "parts")
    m = members.join(groups, "cluster").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int")).drop("parts")
    first = Window.partitionBy("cluster").orderBy("draw", "node")
    drawn = members.select("cluster", "node", F.xxhash64("node", F.lit(100 + turn)).alias("draw"), F.octet_length("grams").cast("long").alias("size")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS)
    drawn = drawn.withColumn("upto", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rank") == 1) | (F.col("upto") <= PIVOT_BYTES))
    drawn = common.stored(drawn.select("cluster", "node", F.col("rank").cast("long").alias("rank")), "drawn")
    pivots = common.stored(members.join(drawn, ["cluster", "node"]).join(groups, "cluster").select("cluster", "rank", "node", "grams", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "pivots")

    def run(own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        similar, near = compare([np.frombuffer(g, np.uint64) for g in own["grams"]], [np.frombuffer(g, np.uint64) for g in drawn["grams"]], percent)
        rank, node = drawn["rank"].to_numpy(), drawn["node"].to_numpy()
        hangs = similar.any(1)
        on = np.where(hangs, similar.argmax(1), 0)
        return pd.DataFrame({
            "cluster": own["cluster"], "node": own["node"], "pivot": np.where(hangs, rank[on], 0), "hub": np.where(hangs, node[on], 0),
            "others": [rank[np.flatnonzero(s)[1:]].tolist() for s in similar], "near": [[] if h else rank[n].tolist() for n, h in zip(near, hangs, strict=True)],
            "close": [rank[n].tolist() if h else [] for n, h in zip(near, hangs, strict=True)],
        })

    told = m.groupBy("cluster", "part").cogroup(pivots.groupBy("cluster", "part")).applyInPandas(run, "cluster long, node long, pivot long, hub long, others array<long>, near array<long>, close array<long>")
    told = common.stored(told, "told")
    hang = told.where("pivot > 0")
    row = lambda df, what, x, y: df.select("cluster", F.lit(what).alias("what"), x.alias("x"), y.alias("y"))
    facts = row(drawn, 0, F.col("rank"), F.col("node")).unionByName(row(hang.groupBy("cluster", "pivot").agg(F.count(F.lit(1)).alias("n")), 1, F.col("pivot"), F.col("n")))
    facts = facts.unionByName(row(hang.select("cluster", "pivot", F.explode("others").alias("other")).distinct(), 2, F.col("pivot"), F.col("other")))

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, main, edges = main_component(pdf)
        rows = [(key[0], x, x in main, None, None) for x in node] + [(key[0], 0, False, a, b) for a, b in edges]
        return pd.DataFrame(rows, columns=["cluster", "pivot", "main", "a", "b"]).astype({"a": "Int64", "b": "Int64"})

    judged = common.stored(facts.groupBy("cluster").applyInPandas(judge, "cluster long, pivot long, main boolean, a long, b long"), "judged")
    main = judged.where("main").select("cluster", "pivot")
    edges = [hang.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")), judged.where("a is not null").select("a", "b")]
    apart = common.stored(told.join(main, ["cluster", "pivot"], "left_anti").select("cluster", "node", F.concat("near", "close").alias("near")), "apart")
    left = common.stored(members.join(apart.select("cluster", "node"), ["cluster", "node"]), "left")

    # nodes apart against the nodes of every pivot of the main component that may have one similar to them
    pairs = common.stored(apart.select("cluster", "node", F.explode("near").alias("pivot")).join(main, ["cluster", "pivot"], "left_semi"), "near")
    wanted = pairs.select("cluster", "pivot").distinct()
    held = hang.select("cluster", "node", "pivot").join(wanted, ["cluster", "pivot"], "left_semi")
    count = lambda df, name: df.groupBy("cluster", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = common.stored(count(held, "in_i").join(count(pairs, "in_j"), ["cluster", "pivot"]), "dealt")

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own, other = ("i", "j") if side == 0 else ("j", "i")
        d = df.join(blocks, ["cluster", "pivot"]).withColumn(own, F.pmod(F.xxhash64("node", F.lit(7)), F.col(f"in_{own}")).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"in_{other}") - 1))).select("cluster", "pivot", "i", "j", F.lit(side).alias("side"), "node", "grams")

    both = dealt(members.join(held, ["cluster", "node"]), 0).unionByName(dealt(left.join(pairs, ["cluster", "node"]), 1))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = forest(pdf["node"].to_numpy(), pdf["side"].to_numpy(), [np.frombuffer(g, np.uint64) for g in pdf["grams"]], percent)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    edges.append(both.groupBy("cluster", "pivot", "i", "j").applyInPandas(verify, "a long, b long"))
    return edges, left


def _cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect what is similar in every cluster; members: (node, cluster, grams). The edges of each turn are written before the next, so that no plan holds more than one turn."""
    members = common.stored(members, "clusters")
    edges: list[DataFrame] = []
    for turn in range(TURNS + 1):
        sizes = common.stored(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("grams").cast("long")).alias("bytes")).where("size > 1"), "sizes")
        large = sizes.where(F.col("size") > BLOCK)
        last = turn == TURNS or large.isEmpty()
        own = sizes if last else sizes.where(F.col("size") <= BLOCK)
        waves = max(1, -(-int(own.agg(F.sum(F.col("bytes") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0) // WAVE_BYTES)) if last else 1
        for wave in range(waves):
            edges.append(common.stored(_in_blocks(members, own, percent, *((wave, waves) if waves > 1 else ())), "edges"))
            if waves > 1:
                common.collect_garbage(members.sparkSession)
        if last:
            break
        found, members = _around_pivots(members.join(large.select("cluster"), "cluster", "left_semi"), large, percent, turn)
        edges += [common.stored(e, "edges") for e in found]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs: components of the pairs with 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    common.text_batches(spark)
    source = _source(docs, text_col, id_col)
    bits = int(np.clip(np.ceil(np.log2(max(1, source.count()) * 8)), *SKETCH_BITS))
    both = common.stored(_heads(source, words, bits), "heads")
    heads = both.where("part is null").select("doc_id", "n", "s1", "s2")
    sketch = spark.sparkContext.broadcast(_sum_sketch(both.where("part is not null").select("part", "salt", "counts"), bits))
    nodes = common.stored(heads.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "nodes")

    some = source.where("doc_id is not null")
    known = spark.sparkContext.broadcast(_crowded(some, words, percent, sketch, bits))
    prefixes = _prefixes(some, words, percent, sketch, bits, known).where("m > 0")
    ids = nodes.select(F.col("node").alias("doc_id")).distinct()
    pairs, members = _met(_postings(prefixes.join(ids, "doc_id", "left_semi")))
    pairs = common.stored(pairs, "pairs")

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    own = common.stored(_sets_of(source, common.stored(wanted, "wanted"), words), "sets")
    with_sets = pairs.join(own.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    links = common.stored(_verified(with_sets, percent).unionByName(_cluster_links(members.join(own, "node"), percent)), "links")
    found = connected_components(links)

    full = heads.join(nodes, ["n", "s1", "s2"], "left").join(found, "node", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame, str], DataFrame], id_col: str) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: of each the row with the smallest id; rows without an id stay.

    groups: the components of a table by a column of whole numbers. They are
    found over numbers of the rows, so ids of any type that has an order will
    do, and rows that share an id but not their text are documents of their own.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    held = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    some = held.where(F.col(f"`{id_col}`").isNotNull())
    told = groups(some, row).select(F.col("doc_id").alias("_own"), "component_id")
    told = common.stored(some.select(F.col(row).alias("_own"), F.col(f"`{id_col}`").alias("_id")).join(told, "_own"), "told")
    best = told.groupBy("component_id").agg(F.min(F.struct("_id", "_own"))["_own"].alias("_best"))
    gone = told.join(best, "component_id").where("_own <> _best").select("_own")
    return held.join(gone, held[row] == gone["_own"], "left_anti").drop(row)


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component of docs, that of the smallest id, with all its columns; rows without an id stay."""
    return one_of_each(docs, lambda rows, row: near_groups(rows, words, percent, text_col, row), id_col)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"), words=4, percent=85)


#: All pairs that share a shingle, which small tables allow.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
p AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS k
  FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (
  SELECT x, y FROM i WHERE 100 * k >= 85 * (n - k)),
e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT s.doc_id, len(s.g) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.g)
"""
