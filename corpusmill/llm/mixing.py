"""Mixing of sources to target weights by temperature, in DataFrame operations only.

Token shares p of the sources are raised to an exponent that is bisected until
the mixture meets a target entropy or a limit on repetition. The weights are
then realised whole: each source runs through as many seeded permutations of
its documents as its weight asks for, the last of them up to its token budget,
in blocks of equal token counts. Every document is emitted at least once. The
place of a block is the share of its source's tokens that lie before it:
blocks in the order of places are one permutation over all sources, of which
every stretch has the target weights.

Running totals are taken in a tree (documents in small hash buckets, buckets
in runs, runs in a permutation), so that no source meets in one task. Rows with
the same id, source and number of tokens are one with a count before that.

Defined results
* null source: a source of its own; null doc_id: sorts by an empty id
* null and empty texts, and sources of such: no tokens, emitted once
* very long texts: one document is never split, a partial pass stops before
  the first document that would exceed its budget in the running total
* ties of the hash: by id, then by number of tokens; rows with the same of all
  three are emitted together or not at all in a partial pass
* ids of any type that has an order; empty table: empty result
* extra or clashing columns: carried by ``mix``, never looked at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: No source is repeated more often than this.
MAX_REPEATS = 2.0
BLOCK_TOKENS = 65_536
SEED = "mix-1"
#: Documents in a bucket on average, and buckets in a run.
BUCKET = 100
RUN = 1_000
#: Passes of the bisection; each halves the bracket HALVINGS times at once.
PASSES = 5
HALVINGS = 5


def _exponent(shares: DataFrame, max_repeats: float, target_entropy: float | None) -> float:
    """The exponent from 0 (all sources alike) to 1 (as they are) that meets the target. shares: t > 0 by source; only scalars are gathered."""
    total, most = shares.agg(F.sum("t"), F.max("t")).first()
    if not total:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << HALVINGS
        at = [lo + (hi - lo) * k / n for k in range(1, n)]
        if target_entropy is None:
            meets = [F.max(F.pow(F.col("t") / most, F.lit(a - 1))) <= max_repeats for a in at]
        else:  # H(q) = log(sum w) - sum(w log w) / sum(w), of w = p ** a
            w = [F.pow(F.col("t") / total, F.lit(a)) for a in at]
            meets = [F.log(F.sum(x)) - F.sum(x * F.log(x)) / F.sum(x) <= target_entropy for x in w]
        row = shares.agg(*[m.alias(f"m{k}") for k, m in enumerate(meets)]).first()
        k = next((k for k, ok in enumerate(row) if ok), n - 1)
        lo, hi = (at[k - 1] if k else lo), (at[k] if k < n - 1 else hi)
    return hi


def source_weights(sizes: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """sizes: (source, t, n). Adds repeats, the number of passes with its fraction, and weight."""
    alpha = _exponent(sizes.where("t > 0"), max_repeats, target_entropy)
    most = sizes.agg(F.max("t")).first()[0] or 1
    sizes = sizes.withColumn("repeats", F.when(F.col("t") > 0, F.pow(F.col("t") / most, F.lit(alpha - 1))).otherwise(1.0))
    whole = sizes.agg(F.sum(F.col("repeats") * F.col("t"))).first()[0] or 1.0
    return sizes.withColumn("weight", F.round(F.col("repeats") * F.col("t") / whole, 9))


def _key(pass_: Column, id_: Column) -> Column:
    """What documents are permuted by in a pass."""
    return F.md5(F.concat_ws("|", F.lit(SEED), pass_.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def _tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def _plan(docs: DataFrame, max_repeats: float, target_entropy: float | None, text_col: str, id_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, c: rows alike), and by source what is to be emitted: t, weight, full passes, token budget of the last one."""
    each = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), _tokens(docs[text_col]).alias("n_tokens"))
    d = common.stored(each.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("c")), "tokens")
    sizes = common.stored(d.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("c")).alias("t"), F.count(F.lit(1)).alias("n")), "sizes")
    plan = (
        source_weights(sizes, max_repeats, target_entropy)
        .withColumn("full", F.floor("repeats").cast("int"))
        .withColumn("budget", F.floor((F.col("repeats") - F.col("full")) * F.col("t")).cast("long"))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    )
    return d, common.stored(plan.drop("n", "repeats"), "plan")


def _emitted(d: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of d for each pass in which they are emitted, with reached, the tokens of the pass up to and with them."""
    rows = d.join(plan, d["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = rows.withColumn("pass", F.explode(F.when((F.col("budget") > 0) & (F.col("n_tokens") > 0), F.sequence(F.lit(0), "full")).otherwise(F.sequence(F.lit(0), F.col("full") - 1))))
    rows = rows.withColumn("key", _key(F.col("pass"), F.col("doc_id"))).withColumn("s", F.col("n_tokens") * F.col("c"))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("buckets")))
    rows = rows.withColumn("run", F.expr(f"bucket div {RUN}"))
    sums = common.stored(rows.groupBy("source", "pass", "run", "bucket").agg(F.sum("s").alias("s")), "buckets")
    before = lambda *over: F.coalesce(F.sum("s").over(Window.partitionBy(*over[:-1]).orderBy(over[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = common.stored(sums.groupBy("source", "pass", "run").agg(F.sum("s").alias("s")).withColumn("in_pass", before("source", "pass", "run")).drop("s"), "runs")
    places = sums.withColumn("in_run", before("source", "pass", "run", "bucket"))
    same = places["source"].eqNullSafe(runs["source"]) & (places["pass"] == runs["pass"]) & (places["run"] == runs["run"])
    places = common.stored(places.join(runs, same).select(places["source"].alias("of"), places["pass"].alias("p"), places["bucket"].alias("b"), (F.col("in_run") + F.col("in_pass")).alias("offset")), "places")
    placed = rows.join(places, rows["source"].eqNullSafe(places["of"]) & (rows["pass"] == places["p"]) & (rows["bucket"] == places["b"]))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("reached", F.col("offset") + F.sum("s").over(inside)).where((F.col("pass") < F.col("full")) | (F.col("reached") <= F.col("budget")))


def mixture(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row for each emission: doc_id, source, n_tokens, pass, block (of the pass), place (of the block in the mixture, billionths of its source's tokens), weight."""
    placed = _emitted(*_plan(docs, max_repeats, target_entropy, text_col, id_col, source_col))
    placed = placed.withColumn("block", F.expr(f"(reached - s) div {BLOCK_TOKENS}"))
    before, whole = (F.col("pass") * F.col("t") + F.col("block") * BLOCK_TOKENS).cast("double"), (F.col("full") * F.col("t") + F.col("budget")).cast("double")
    place = F.floor(before * 1e9 / F.greatest(whole, F.lit(1.0))).cast("long")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c"))))
    return each.select("doc_id", "source", "n_tokens", F.col("pass").cast("int").alias("pass"), "block", place.alias("place"), "weight")


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mixture emits it.

    What a partial pass emits is the beginning of its permutation, so rows only
    need to know where their source's ends: one row a source, which Spark
    broadcasts where it is small; texts don't move then.
    """
    d, plan = _plan(docs, max_repeats, target_entropy, text_col, id_col, source_col)
    last = _emitted(d, plan.where("budget > 0")).where(F.col("pass") == F.col("full")).groupBy("source").agg(F.max(F.struct("key", F.col("doc_id").isNotNull().alias("has"), "doc_id", "n_tokens")).alias("last"))
    last = last.select(F.col("source").alias("of"), "last")
    ends = common.stored(plan.join(last, plan["source"].eqNullSafe(last["of"]), "left").select("source", "full", "last"), "ends")
    names = docs.columns
    row = lambda c: F.col(f"_row.`{c}`")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    held = held.join(ends, row(source_col).eqNullSafe(ends["source"]))
    id_, end = row(id_col), F.col("last")
    key = _key(F.col("full"), id_)
    # a tie of hash and id is rare, so tokens are hardly ever counted
    inside = F.when(end.isNull(), False).when(key != end["key"], key < end["key"]).when(~id_.eqNullSafe(end["doc_id"]), F.coalesce(id_ < end["doc_id"], id_.isNull())).otherwise(_tokens(row(text_col)) <= end["n_tokens"])
    some = F.coalesce(row(text_col), F.lit("")).rlike(common.WORD)
    out = held.select("_row", F.explode(F.sequence(F.lit(1), F.col("full") + (inside & some).cast("int"))))
    return out.select([row(c).alias(c) for c in names])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(common.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len({common.sql_words('text')}) AS BIGINT) AS n_tokens FROM documents),
s AS (
  SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY source),
e AS (
  SELECT max(t) AS most, min(t) FILTER (WHERE t > 0) AS least FROM s),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         CASE WHEN pow(least / most, (lo + hi) / 2 - 1) <= {MAX_REPEATS} THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(least / most, (lo + hi) / 2 - 1) <= {MAX_REPEATS} THEN (lo + hi) / 2 ELSE hi END
  FROM b, e WHERE i < {PASSES * HALVINGS}),
a AS (
  SELECT hi AS alpha FROM b WHERE i = {PASSES * HALVINGS}),
r AS (
  SELECT source, t, CASE WHEN t > 0 THEN pow(t / most, alpha - 1) ELSE 1.0 END AS repeats FROM s, e, a),
w AS (
  SELECT source, t, repeats, CAST(floor(repeats) AS INTEGER) AS full_passes,
         CAST(floor((repeats - floor(repeats)) * t) AS BIGINT) AS budget,
         round(repeats * t / sum(repeats * t) OVER (), 9) AS weight
  FROM r),
x AS (
  SELECT doc_id, source, n_tokens, t, full_passes, budget, weight,
         unnest(range(0, full_passes + CASE WHEN budget > 0 AND n_tokens > 0 THEN 1 ELSE 0 END)) AS pass
  FROM d JOIN w USING (source)),
c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY md5('{SEED}|' || pass || '|' || doc_id), doc_id
                                ROWS UNBOUNDED PRECEDING) AS reached FROM x)
SELECT doc_id, source, n_tokens, CAST(pass AS INTEGER) AS pass, CAST((reached - n_tokens) // {BLOCK_TOKENS} AS BIGINT) AS block,
       CAST(floor(CAST(pass * t + (reached - n_tokens) // {BLOCK_TOKENS} * {BLOCK_TOKENS} AS DOUBLE) * 1e9 / greatest(CAST(full_passes * t + budget AS DOUBLE), 1.0)) AS BIGINT) AS place, weight
FROM c WHERE pass < full_passes OR reached <= budget
"""
