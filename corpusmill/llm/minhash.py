"""MinHash near-duplicates by an inverted join of signature coordinates.

A text is the set of its word shingles; equal sets are one node. A node's
signature has COORDINATES minima under as many hash functions; the values of
BAND neighbouring coordinates are a posting, whose list has the nodes with the
same. Similar sets collide in a share of the coordinates that follows their
Jaccard similarity, so pairs with at least ``threshold`` collisions are
retained and confirmed on their full sets. The threshold is the largest that a
pair just similar enough fails with a probability of at most MISS; that of the
postings that it shares is of the same kind, so MISS counts twice. Postings of
single coordinates would have lists that grow with the corpus until unrelated
sets meet in many of them, as common shingles are minima of many sets.

Two nodes with t common postings share at least m of the first K - t + m
in any common order, so only these prefixes meet, rare lists first. Lists of
few nodes are merged: their collisions are counted pair by pair. Long lists
are skipped; what they may add to a count is bounded, and looked up in the
signatures of the pairs that are left. Nodes that may collide often enough in
long lists alone form clusters. Short texts around a few common lines hang
together in one that grows with the corpus, though hardly any two are similar;
so the nodes of large clusters meet once more, by the rarest shingles of their
full sets among themselves. What only common shingles hold together then is
compared on full sets around pivots as the n-gram join does it. No list is cut.

Defined results
* null, empty and blank texts: no shingle, linked with nothing
* fewer words than a shingle has: the whole sequence is the only shingle
* very long texts: whole
* ids are whole numbers, others fail; rows with the same id are one document,
  whatever their texts; for ``drop_near_copies`` ids may be of any type, and
  rows are documents
* null id: linked with nothing, null component, kept
* ties and repeated rows: one row of the smallest id of a component stays
* empty table: empty result
* extra or clashing columns: carried by ``drop_near_copies``, never looked at
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near_join
from .components import connected_components
from .shingles import mix, sets

#: Hash functions; a signature has four bytes for each.
COORDINATES = 96
#: Probability that a pair at the similarity asked for has too few collisions.
MISS = 1e-10
#: Neighbouring coordinates that make one posting: unrelated texts share one in about the square of their similarity.
BAND = 2
#: Postings that a pair must share in its prefixes before it is looked at.
MATCHES = 8
#: Shingles hashed at once, so that they stay in a core's cache.
SLICE = 1 << 16
#: Counters of the sketch for each node of large clusters, within the same bounds.
SHINGLES = 64
#: Counters of the sketch that orders the lists: 2^16 to 2^24, about one for four postings.
SKETCH_BITS = (16, 24)
_rng = np.random.Generator(np.random.PCG64(20240311))
_SEEDS = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0x94D049BB133111EB)


def threshold(percent: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of collisions that a pair of this similarity reaches with a probability of 1 - miss at least."""
    p, total = percent / 100, 0.0
    for t in range(coordinates + 1):
        total += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if total > miss:
            return t
    return coordinates


def signatures(grams: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set, none of them empty: the high halves of 64-bit hashes."""
    out = np.zeros((len(grams), COORDINATES), np.uint32)
    size = np.array([len(g) for g in grams], np.int64)
    k = 0
    while k < len(grams):
        j = k + max(1, int(np.searchsorted(np.cumsum(size[k:]), SLICE, "right")))
        flat = np.concatenate(grams[k:j])
        first = np.cumsum(size[k:j]) - size[k:j]
        x, y = np.empty_like(flat), np.empty_like(flat)
        for c in range(COORDINATES):
            np.bitwise_xor(flat, _SEEDS[c], out=x)
            np.multiply(x, _FACTORS[c], out=x)
            np.right_shift(x, np.uint64(32), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _SPREAD, out=x)
            out[k:j, c] = np.minimum.reduceat(x, first) >> np.uint64(32)
        k = j
    return out


def _heads(source: DataFrame, words: int) -> DataFrame:
    """doc_id, n, s1, s2, sig: the size of each set, 128 bits that stand for it, and its signature (empty without shingles)."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                grams = list(sets(batch.column(1), words))
                n = [len(u) for u in grams]
                s1 = [int(mix(u).sum(dtype=np.uint64)) for u in grams]
                s2 = [int(np.bitwise_xor.reduce(mix(u + np.uint64(0x5851F42D4C957F2D)))) if len(u) else 0 for u in grams]
                some = iter(signatures([u for u in grams if len(u)]))
                sig = [next(some).tobytes() if k else b"" for k in n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "s1", "s2", "sig"],
                )

    return source.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sig binary")


def bands(percent: int) -> tuple[int, int]:
    """(coordinates of a posting, postings that a pair just similar enough shares with a probability of 1 - MISS at least): BAND of them where that leaves MATCHES, else single ones."""
    shared = threshold(percent**BAND / 100 ** (BAND - 1), COORDINATES // BAND)
    return (BAND, shared) if shared >= MATCHES else (1, threshold(percent))


def _tokens(column: pa.Array, band: int) -> np.ndarray:
    """(rows, COORDINATES // band): the values of each band with its place as one number."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES // band, band).astype(np.uint64)
    out = np.tile(np.arange(COORDINATES // band, dtype=np.uint64), (len(values), 1))
    for k in range(band):
        out = mix(out << np.uint64(32) ^ out ^ values[:, :, k])
    return out


def _sketch(packed: DataFrame, tokens: Callable[[pa.Array], np.ndarray], bits: int) -> np.ndarray:
    """About how many nodes each list has, by the high bits of its token; tokens: those of the only column."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            counts += np.bincount((tokens(batch.column(0)) >> np.uint64(64 - bits)).astype(np.int64).ravel(), minlength=1 << bits).astype(np.uint32)
        if counts.any():
            k, salt = near_join.SKETCH_PARTS, int(counts[: 1 << 10].sum()) % near_join.FAN_IN
            parts = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(k, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([salt] * k, pa.int32()), pa.array(parts, pa.binary())], ["part", "salt", "counts"])

    return near_join._sum_sketch(packed.mapInArrow(run, "part int, salt int, counts binary"), bits)


def _postings(nodes: DataFrame, band: int, prefix: int, matches: int, sketch, bits: int) -> DataFrame:
    """token, node, m, part: the first postings of each node, rare lists first; part: from 1 on in lists of very many nodes, else 0."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                tokens = _tokens(batch.column(1), band)
                seen = counts[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((tokens, (4 * np.log2(np.maximum(seen, 1))).astype(np.int8)), axis=1)[:, :prefix]
                token = np.take_along_axis(tokens, order, 1).ravel()
                hot = np.take_along_axis(seen, order, 1).ravel() > near_join.HOT
                node = np.repeat(batch.column(0).to_numpy(), prefix)
                part = np.where(hot, 1 + mix(node.view(np.uint64)) % np.uint64(near_join.HOT_PARTS), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(np.full(len(node), matches, np.int32)), pa.array(part)], ["token", "node", "m", "part"])

    return nodes.select("node", "sig").mapInArrow(run, "token long, node long, m int, part int")


def _colliding(pairs: DataFrame, nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b) of the pairs with enough collisions over all coordinates, and sizes that allow the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in (2, 3))
            keep = (x == y).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _shingles(column: pa.Array) -> np.ndarray:
    """The shingles of all sets in a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def _unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, np.uint64) for x in column.to_pylist())


def _by_shingles(held: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) that may be similar, and (node, cluster) of what may be so by common shingles alone, for nodes of large clusters (node, grams)."""
    bits = int(np.clip(np.ceil(np.log2(max(1, held.count()) * SHINGLES)), *SKETCH_BITS))
    sketch = held.sparkSession.sparkContext.broadcast(_sketch(held.select("grams"), _shingles, bits))
    prefixes = held.select("node", "grams").mapInArrow(common.tidy(near_join._prefixes_of(_unpacked, percent, sketch, bits)), near_join.PREFIX)
    return near_join._met(near_join._postings(prefixes))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs: components of the pairs with 100 * intersection >= percent * union."""
    with common.batches(docs.sparkSession):
        return _near_groups(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), words, percent)


def _near_groups(source: DataFrame, words: int, percent: int) -> DataFrame:
    """What near_groups returns, for (doc_id, text); all but the last joins has run when it returns."""
    least = threshold(percent)
    heads = common.stored(_heads(source, words), "heads")
    nodes = heads.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2", "sig").agg(F.min("doc_id").alias("node"))
    nodes = common.stored(nodes, "nodes")
    # a set so small that no other can be similar to it meets no one
    able = nodes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("node", "n", "sig")
    bits = int(np.clip(np.ceil(np.log2(max(1, able.count()) * COORDINATES / 4)), *SKETCH_BITS))
    band, shared = bands(percent)
    matches = max(1, min(MATCHES, shared))
    sketch = source.sparkSession.sparkContext.broadcast(_sketch(able.select("sig"), partial(_tokens, band=band), bits))

    postings = _postings(able, band, min(COORDINATES // band, COORDINATES // band - shared + matches), matches, sketch, bits)
    pairs, members = near_join._met(postings)
    pairs = common.stored(_colliding(pairs, able, least, percent), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    known = common.stored(near_join._sets_of(source, common.stored(wanted, "wanted"), words), "sets")
    large = common.stored(members.groupBy("cluster").count().where(F.col("count") > near_join.BLOCK), "large")
    if not large.isEmpty():
        held = common.stored(members.join(large, "cluster", "left_semi").join(known, "node").select("node", "grams"), "held")
        more, dense = _by_shingles(held, percent)
        pairs = pairs.unionByName(common.stored(_colliding(more, able, least, percent), "more")).distinct()
        members = members.join(large, "cluster", "left_anti").unionByName(dense)
    with_sets = pairs.join(known.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    links = common.stored(near_join._verified(with_sets, percent).unionByName(near_join._cluster_links(members.join(known, "node"), percent)), "links")
    found = connected_components(links)

    full = heads.drop("sig").join(nodes.drop("sig"), ["n", "s1", "s2"], "left").join(found, "node", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component of docs, that of the smallest id, with all its columns; rows without an id stay."""
    return near_join.one_of_each(docs, lambda rows, row: near_groups(rows, words, percent, text_col, row), id_col)


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(common.table(spark, sf_dir, "documents"), words=2, percent=80)
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: All pairs that share a shingle, which small tables allow.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN [w[1]] ELSE [] END AS g FROM d),
p AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS k
  FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (
  SELECT x, y FROM i WHERE 100 * k >= 80 * (n - k)),
e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT s.doc_id, len(s.g) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.g)
"""
