"""A keyword index that follows its corpus: segments, block maxima and a running threshold.

Chunks that come together form a segment. Their terms are counted once and
kept; everything else is derived from the counts, so neither later additions
nor merges tokenise a chunk again. Statistics are sums over segments, with
negative rows for chunks that went; these are marked, and merges of segments
of like size fold the marks in. All tables of the index live in one versioned
store, so a search sees one state of all of them.

In a segment, chunks with the same leading term stand together in a task's
order, in blocks of at most BLOCK. For each block and term the index keeps the largest frequency and the
least length, which bound what the block's chunks can score. A search first
scores, for each query, the blocks with the highest bounds; the k-th score
found is a threshold below which all other blocks are skipped unread.

Defined results
* null and empty texts: chunks without terms, which count among the tenant's
  chunks and are never found
* a chunk id that the tenant has already: the new chunk takes its place;
  repeated ids in one update: the caller's fault, all are kept
* queries of tenants without chunks, and without known terms: no rows
* ties: the smaller chunk id; an empty index: no rows
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..params import DEFAULT, Params
from ..sources import places
from ..sources.store import Change, State, Store

#: Chunks of a block.
BLOCK = 8
#: Blocks of a query that are scored before there is a threshold.
FIRST = 4
#: Bytes of files that one task reads for a segment. It sorts what it reads, which takes many times the room: a term of a chunk some 50 bytes.
SORT_BYTES = 16 << 20
#: Segments of like size that are merged, and how much larger the next size is.
FAN_IN = 4
KEYS = {
    "tokens": ("segment", "user_id", "chunk_id"),
    "blocks": ("segment", "user_id", "term"),
    "terms": ("segment", "user_id", "term"),
    "totals": ("segment", "user_id"),
    "deleted": ("segment", "user_id", "chunk_id"),
    "lost_terms": ("segment", "user_id", "term"),
    "lost_totals": ("segment", "user_id"),
    "tenants": ("user_id",),
}
#: Tables of which a segment has files of its own, and those that a merge clears of a segment's rows.
OWN = ("tokens", "blocks", "terms", "totals")
LOST = ("deleted", "lost_terms", "lost_totals")


def counted(chunks: DataFrame, tokenizer=tx.words) -> DataFrame:
    """user_id, chunk_id, dl, terms (term, tf), lead: what a chunk's text comes to; lead is its most frequent term. Whole batches are counted at once."""
    kind = dict(chunks.dtypes)["chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            known = max(1, len(words.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(size)), size) * known + words.indices.to_numpy().astype(np.int64), return_counts=True)
            row, code = key // known, key % known
            offsets = np.searchsorted(row, np.arange(len(size) + 1))
            terms = words.dictionary.take(pa.array(code))
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([terms, pa.array(tf, pa.int32())], ["term", "tf"]))
            order = np.lexsort((code, -tf, row))
            first = order[np.minimum(offsets[:-1], max(0, len(order) - 1))] if len(order) else np.zeros(len(size), np.int64)
            lead = terms.take(pa.array(first, mask=offsets[1:] == offsets[:-1])) if len(order) else pa.nulls(len(size), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32), mask=lists.is_null().to_numpy(zero_copy_only=False)), held, lead], ["user_id", "chunk_id", "dl", "terms", "lead"])

    return chunks.select("user_id", "chunk_id", tokenizer(F.col("text")).alias("terms")).mapInArrow(run, f"user_id string, chunk_id {kind}, dl int, terms array<struct<term string, tf int>>, lead string")


def in_blocks(tokens: DataFrame) -> DataFrame:
    """user_id, term, block, n, max_tf, min_dl, hits (chunk_id, tf, dl): runs of at most BLOCK of a tenant's chunks, in the order in which a task has them, nothing is shuffled."""
    kind = dict(tokens.dtypes)["chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        used = 0
        for batch in batches:
            user, chunk, dl, lists = (batch.column(k) for k in range(4))
            if not batch.num_rows:
                continue
            codes = pc.fill_null(user.dictionary_encode().indices, -1).to_numpy()
            first = np.r_[True, codes[1:] != codes[:-1]]
            run_of = np.cumsum(first) - 1
            within = np.arange(len(codes)) - np.flatnonzero(first)[run_of]
            block = np.cumsum(first | (within % BLOCK == 0)) - 1
            flat = lists.flatten()
            row = np.repeat(np.arange(len(codes)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            words, tf = flat.field(0).dictionary_encode(), flat.field(1).to_numpy()
            if len(row):
                term = words.indices.to_numpy()
                order = np.lexsort((row, term, block[row]))
                row, term, tf = row[order], term[order], tf[order]
                new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[row[1:]] != block[row[:-1]])])
                length = pc.fill_null(dl, 0).to_numpy()[row]
                hits = pa.StructArray.from_arrays([chunk.take(pa.array(row)), pa.array(tf), pa.array(length)], ["chunk_id", "tf", "dl"])
                ends = np.r_[new, len(row)]
                yield pa.RecordBatch.from_arrays(
                    [
                        user.take(pa.array(row[new])), words.dictionary.take(pa.array(term[new])), pa.array(task + used + block[row[new]]), pa.array(np.diff(ends).astype(np.int32)),
                        pa.array(np.maximum.reduceat(tf, new)), pa.array(np.minimum.reduceat(length, new)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits),
                    ],
                    ["user_id", "term", "block", "n", "max_tf", "min_dl", "hits"],
                )
            used += int(block[-1]) + 1

    return tokens.select("user_id", "chunk_id", "dl", "terms").mapInArrow(run, f"user_id string, term string, block long, n int, max_tf int, min_dl int, hits array<struct<chunk_id {kind}, tf int, dl int>>")


def saturation(tf: Column, dl: Column, avgdl: Column, p: Params) -> Column:
    return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * dl / avgdl))


class KeywordIndex:
    """An index below a folder; a second object on the same folder sees and changes the same index."""

    def __init__(self, spark: SparkSession, root: str, p: Params = DEFAULT, tokenizer=tx.words):
        self.spark, self.p, self.tokenizer = spark, p, tokenizer
        self.store = Store(spark, root, KEYS)

    # -- changes ----------------------------------------------------------------

    def update(self, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """chunks: (user_id, chunk_id, text) that come; gone: (user_id, chunk_id) that go. One version; chunks that are there already are replaced."""
        written: dict[str, tuple] = {}
        if chunks is not None:
            with _read_at_once(self.spark, SORT_BYTES):
                written = self._segment(counted(chunks, self.tokenizer))
        fresh = self._read(written, "tokens").select("user_id", "chunk_id") if written else None
        leaving = gone.select("user_id", "chunk_id") if gone is not None else None
        leaving = fresh if leaving is None else leaving if fresh is None else leaving.unionByName(fresh)

        def work(state: State) -> Change | None:
            out = self.store.added(state, written, None)
            lost: dict[str, tuple] = {}
            if leaving is not None and "tokens" in state.schemas:
                lost = self._lose(state, leaving, out)
            if not out.add and not out.drop:
                return None
            changed = [self._read(t, n).select("user_id") for t, n in ((written, "totals"), (lost, "lost_totals")) if n in t and t[n][0]]
            if changed:
                self._tenants(state, written, lost, changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1]), out)
            return out

        return self.store.commit(work)

    def merge(self, every: bool = False) -> int:
        """Put segments of like size together, FAN_IN at a time, until no size has so many; every: all into one. Marks of chunks that went are folded in."""
        while True:
            before = self.store.version()
            done: dict[str, dict] = {}

            def work(state: State, done: dict = done) -> Change | None:
                chosen = self._like_sized(state, every)
                if not chosen:
                    return None
                files = [f for f in state.of("tokens") if f.low["segment"] in chosen]
                key = json.dumps(sorted((f.path, f.marks) for f in files))
                if key not in done:
                    with _read_at_once(self.spark, SORT_BYTES):
                        done[key] = self._segment(self.store.read("tokens", state, files).drop("segment"))
                out = self.store.added(state, done[key], None)
                out.drop += [f.path for t in OWN for f in state.of(t) if f.low["segment"] in chosen]
                names = self.spark.createDataFrame([(s,) for s in sorted(chosen)], "segment string")
                for t in LOST:
                    if t in state.schemas:
                        self.store.mark(state, t, names, out)
                return out

            if self.store.commit(work) == before or every:
                return self.store.version()

    def segments(self, state: State | None = None) -> dict[str, int]:
        """The chunks of each segment, as it was written, without those marked as deleted."""
        out: dict[str, int] = {}
        for f in (state or self.store.state()).of("tokens"):
            out[f.low["segment"]] = out.get(f.low["segment"], 0) + f.rows - f.gone
        return out

    # -- search -----------------------------------------------------------------

    def search(self, queries: DataFrame, told: dict | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank: the best chunks of each query's tenant. queries: (query_id, user_id, text). told takes the number of blocks that have terms of their query, and of those scored."""
        state = self.store.state()
        if "tenants" not in state.schemas:
            return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id long, score double, rank int")
        words = self._stored(self._weighed(state, queries), "words")
        blocks = self.store.read("blocks", state)
        most = F.greatest(F.col("w"), F.lit(0.0)) * saturation(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), self.p)
        bounds = blocks.drop("hits").join(words, ["user_id", "term"]).groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"))
        bounds = self._stored(bounds, "bounds")
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        first = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST).select("query_id", "segment", "block")
        scored = self._stored(self._scored(state, blocks, words, first), "scored")
        kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        threshold = scored.withColumn("place", F.row_number().over(kth)).where(F.col("place") == self.p.keyword_k).select("query_id", F.col("score").alias("threshold"))
        # sums of the same numbers in another order may differ in their last digits
        rest = bounds.join(first, ["query_id", "segment", "block"], "left_anti").join(threshold, "query_id", "left")
        rest = rest.where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - 1e-6)).select("query_id", "segment", "block")
        if told is not None:
            told |= {"blocks": bounds.count(), "scored": first.count() + rest.count()}
        out = scored.unionByName(self._scored(state, blocks, words, rest))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.p.keyword_k)

    def _weighed(self, state: State, queries: DataFrame) -> DataFrame:
        """query_id, user_id, term, w, avgdl: the weights of the queries' terms."""
        words = queries.select("query_id", "user_id", F.explode_outer(self.tokenizer(F.col("text"))).alias("term")).where("term is not null")
        words = words.groupBy("query_id", "user_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = self._frequency(state, {}, {}, words.select("user_id", "term").distinct(), ["user_id", "term"])
        raw = words.join(asked, ["user_id", "term"]).join(self.store.read("tenants", state), "user_id").withColumn("raw", _idf(F.col("n_docs"), F.col("df")))
        idf = F.when(F.col("raw") < 0, self.p.idf_floor * F.col("mean")).otherwise(F.col("raw"))
        return raw.select("query_id", "user_id", "term", (F.col("qtf") * idf).alias("w"), "avgdl")

    def _scored(self, state: State, blocks: DataFrame, words: DataFrame, chosen: DataFrame) -> DataFrame:
        """query_id, chunk_id, score of the chunks of some blocks that share a term with their query."""
        hits = blocks.join(words, ["user_id", "term"]).join(chosen, ["query_id", "segment", "block"])
        hits = hits.select("query_id", "segment", "user_id", "w", "avgdl", F.explode("hits").alias("h")).select("*", F.col("h.chunk_id").alias("chunk_id"))
        if "deleted" in state.schemas:
            hits = hits.join(self.store.read("deleted", state), ["segment", "user_id", "chunk_id"], "left_anti")
        return hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * saturation(F.col("h.tf"), F.col("h.dl"), F.col("avgdl"), self.p)).alias("score"))

    # -- details ----------------------------------------------------------------

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        """A table of this search or change, which several steps read."""
        path = places.fresh(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _read(self, written: dict[str, tuple], name: str) -> DataFrame:
        """What was written of a table and is not visible yet."""
        files, schema = written[name]
        kind = StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*[f"{self.store.root}/{f.path}" for f in files]) if files else self.spark.createDataFrame([], kind)

    def _segment(self, tokens: DataFrame) -> dict[str, tuple]:
        """The files of a new segment for chunks (user_id, chunk_id, dl, terms, lead). Chunks that stand together in a task's order are a block."""
        name = F.lit(uuid.uuid4().hex).alias("segment")
        written = {"tokens": self.store.write("tokens", tokens.select(name, "user_id", "chunk_id", "dl", "terms", "lead"))}
        held = self._read(written, "tokens")
        blocks = in_blocks(held.sortWithinPartitions("user_id", "lead", "dl", "chunk_id"))
        written["blocks"] = self.store.write("blocks", blocks.select(name, "user_id", "term", "block", "n", "max_tf", "min_dl", "hits"))
        written["terms"] = self.store.write("terms", self._read(written, "blocks").groupBy("user_id", "term").agg(F.sum("n").alias("df")).select(name, "user_id", "term", "df"))
        written["totals"] = self.store.write("totals", _totals(held, ["user_id"], 1).select(name, "user_id", "n_docs", "n_sized", "n_words"))
        return written

    def _lose(self, state: State, leaving: DataFrame, out: Change) -> dict[str, tuple]:
        """Marks chunks as deleted, and writes what statistics lose with them."""
        files = self.store.holders(state, "tokens", leaving)
        if not files:
            return {}
        # by keys alone first: most additions replace nothing, and the terms of all segments would move to find that out
        held = self.store.read("tokens", state, files)
        own = self._stored(held.select("segment", "user_id", "chunk_id").join(leaving.distinct(), ["user_id", "chunk_id"], "left_semi"), "own")
        if own.isEmpty():
            return {}
        gone = self._stored(held.join(own, ["segment", "user_id", "chunk_id"], "left_semi"), "gone")
        terms = gone.select("segment", "user_id", F.explode("terms").alias("t")).groupBy("segment", "user_id", F.col("t.term").alias("term")).agg((-F.count(F.lit(1))).alias("df"))
        lost = {"deleted": gone.select("segment", "user_id", "chunk_id"), "lost_terms": terms, "lost_totals": _totals(gone, ["segment", "user_id"], -1)}
        written = {t: self.store.write(t, rows) for t, rows in lost.items()}
        self.store.mark(state, "tokens", leaving, out)
        more = self.store.added(state, written, None)
        out.add += more.add
        out.schemas |= more.schemas
        return written

    def _all(self, state: State, name: str, *written: dict[str, tuple]) -> DataFrame | None:
        """A table's rows in a version, and those that a change is about to add."""
        parts = [self.store.read(name, state)] if name in state.schemas else []
        parts += [self._read(w, name) for w in written if name in w]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    def _frequency(self, state: State, written: dict, lost: dict, only: DataFrame, keys: list[str]) -> DataFrame:
        """user_id, term, df over all segments, for some tenants or terms."""
        parts = [rows.join(only, keys, "left_semi").select("user_id", "term", "df") for rows in (self._all(state, "terms", written), self._all(state, "lost_terms", lost)) if rows is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy("user_id", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def _tenants(self, state: State, written: dict, lost: dict, changed: DataFrame, out: Change) -> None:
        """Statistics of the tenants that change are worked out anew, the others' are kept."""
        changed = self._stored(changed.distinct(), "changed")
        parts = [rows.select("user_id", "n_docs", "n_sized", "n_words") for rows in (self._all(state, "totals", written), self._all(state, "lost_totals", lost)) if rows is not None]
        totals = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).join(changed, "user_id", "left_semi").groupBy("user_id")
        totals = totals.agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_words") / F.nullif(F.sum("n_sized"), F.lit(0))).alias("avgdl")).where("n_docs > 0")
        mean = self._frequency(state, written, lost, changed, ["user_id"]).join(totals, "user_id").groupBy("user_id").agg(F.avg(_idf(F.col("n_docs"), F.col("df"))).alias("mean"))
        rows = totals.join(mean, "user_id", "left")
        if "tenants" in state.schemas:
            rows = rows.unionByName(self.store.read("tenants", state).join(changed, "user_id", "left_anti"))
        more = self.store.added(state, {"tenants": self.store.write("tenants", rows)}, None)
        out.add += more.add
        out.schemas |= more.schemas
        out.drop += [f.path for f in state.of("tenants")]

    def _like_sized(self, state: State, every: bool) -> set[str]:
        sizes = {f.low["segment"]: 0 for f in state.of("blocks")} | self.segments(state)
        if every:
            return set(sizes) if len(sizes) > 1 or state.of("deleted") else set()
        tiers: dict[int, list[str]] = {}
        for name, n in sizes.items():
            tiers.setdefault(int(math.log(n, FAN_IN)) if n else -1, []).append(name)
        return set(next((names for _, names in sorted(tiers.items()) if len(names) >= FAN_IN), ()))


@contextmanager
def _read_at_once(spark: SparkSession, size: int) -> Iterator[None]:
    """Files are read in parts of at most so many bytes by what runs inside; the setting is as before afterwards."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _totals(tokens: DataFrame, by: list[str], sign: int) -> DataFrame:
    return tokens.groupBy(*by).agg((sign * F.count(F.lit(1))).alias("n_docs"), (sign * F.count("dl")).alias("n_sized"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("n_words"))
