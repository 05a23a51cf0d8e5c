"""Audit of how the sources of a language differ in their terms.

Tasks count terms in their own texts and hand over one row for each language,
source and term; what follows is DataFrame work on counts. Shares are smoothed
and fixed to integers. A source that lacks a term has a baseline share there,
so the sum of |p - q| over all terms is the number of terms times the distance
of both baselines, corrected by what single sources have (for which terms with
equal shares count together) and by the terms that both have.

The top terms of a group are found by radix selection: histograms over the
bits of the values, from the highest digit down, tell each group's k-th value;
ties there are refined by histograms over the bytes of the terms. Only what is
at or above the threshold is ranked, at most k rows a group.

Defined results
* null, empty and blank texts: no terms; null languages and sources: ''
* very long texts and terms: whole
* groups without terms, and languages without kept terms: pairs of value 0
* ties: the smaller term or source by its UTF-8 bytes; repeated rows count
  again, documents are rows
* empty table: empty result
* extra columns: never looked at
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Terms that a task holds before it hands them over; the same term may come again.
HELD = 400_000
#: Bits of a digit of a value, and bytes of a digit of a term.
DIGIT = 10
DIGITS = 6
TERM_DIGIT = 2
UNIT = 1_000_000_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A to Z in lower case, as UTF-8."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term in every group; docs: (lang, source, text)."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, own) in held.items():
            some = list(n)
            for at in range(0, len(some), 50_000):
                part = some[at : at + 50_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k), pa.array([source] * k), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([own[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = terms(text.as_py())
                n, own = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                n.update(words)
                own.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


@dataclass
class Shares:
    """shared: lang, source, term, the shares p of the group and q of the language, and the group's baseline; groups: lang, source, total, v, base."""

    shared: DataFrame
    groups: DataFrame


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 v)) without leaving whole numbers."""
    big = lambda c: c.cast("decimal(27,0)")
    return F.when(v > 0, F.lit(1) + F.call_function("div", (big(n) + 5) * F.lit(UNIT).cast("decimal(10,0)"), big(total) + 5 * big(v))).otherwise(F.lit(0)).cast("long")


def shares(docs: DataFrame, least_docs: int) -> Shares:
    """Shares of the kept terms by group and by language."""
    text = lambda c: F.coalesce(docs[c], F.lit("")).alias(c)
    source = docs.select(text("lang"), text("source"), text("text"))
    in_lang = Window.partitionBy("lang", "term")
    counted = term_counts(source).withColumn("in_docs", F.sum("docs").over(in_lang)).where(F.col("in_docs") >= least_docs)
    kept = counted.select("lang", "source", "term", "n", F.sum("n").over(in_lang).alias("all"), (F.row_number().over(in_lang.orderBy("source")) == 1).alias("one"))
    with common.batches(docs.sparkSession):
        kept = common.stored(kept, "kept")
    langs = kept.groupBy("lang").agg(F.sum(F.col("one").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = source.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = common.stored(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    shared = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("all"), F.col("lang_total"), F.col("v")).alias("q"), "base")
    return Shares(common.stored(shared, "shares"), groups)


def pairs(found: Shares) -> DataFrame:
    """lang, source, item, value: the divergence of every two sources of a language, both ways."""
    g = found.groups
    b = g.select("lang", F.col("source").alias("item"), F.col("base").alias("base_b"))
    apart = F.abs(F.col("base") - F.col("base_b"))
    every = g.join(b, "lang").where(F.col("source") < F.col("item")).select("lang", "source", "item", (F.col("v") * apart).alias("value"))
    # what one source has, against the baseline of the other; terms with equal shares count together
    own = common.stored(found.shared.groupBy("lang", "source", "p", "base").agg(F.count(F.lit(1)).alias("n")), "own")
    alone = own.join(b, "lang").where(F.col("source") != F.col("item")).groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"))
    alone = alone.agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("base_b")) - apart)).alias("value"))
    # what both have
    x = found.shared.select("lang", "term", "source", "p", "base")
    y = found.shared.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("base").alias("base_b"))
    mended = F.abs(F.col("p") - F.col("p_b")) - F.abs(F.col("p") - F.col("base_b")) - F.abs(F.col("p_b") - F.col("base")) + apart
    both = x.join(y, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(mended).alias("value"))
    half = every.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = common.stored(half, "pairs")
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def _narrow(bins: DataFrame, by: list[str], k: Column, descending: bool) -> DataFrame:
    """by, digit, left: the bin of each group that holds its k-th row, and how many rows of it are wanted; bins: by, digit, n, and k."""
    order = F.col("digit").desc() if descending else F.col("digit").asc()
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    told = bins.withColumn("upto", upto).withColumn("left", k - (F.col("upto") - F.col("n")))
    return told.where((F.col("left") > 0) & (F.col("left") <= F.col("n"))).select(*by, "digit", "left", "n")


def top_rows(rows: DataFrame, by: list[str], k: int, item: str = "item", value: str = "value") -> DataFrame:
    """The first k rows of each group by descending value (0 or more, below 2^60), then ascending item, which is distinct in a group."""
    rows = common.stored(rows, "rows")
    # groups of k rows at most are taken whole
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    state = common.stored(sizes.where(F.col("n") > k).select(*by, F.lit(0).cast("long").alias("head"), F.lit(k).cast("long").alias("left")), "state")
    for d in range(DIGITS - 1, -1, -1):
        digit = F.shiftright(F.col(value), d * DIGIT)
        at = rows.join(state, by).where(F.shiftright(F.col(value), (d + 1) * DIGIT) == F.col("head"))
        bins = at.groupBy(*by, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("k"))
        state = common.stored(_narrow(bins, by, F.col("k"), True).select(*by, F.col("digit").alias("head"), "left"), "state")
    # ties at the k-th value, refined by pieces of the items' bytes until none is left that is wanted in part
    ties = common.stored(rows.join(state, by).where(F.col(value) == F.col("head")).select(*by, item, F.col("head"), "left"), "ties")
    taken = [rows.join(state.select(*by, "head"), by, "left").where(F.col("head").isNull() | (F.col(value) > F.col("head"))).select(*rows.columns)]
    place = 1
    while not ties.isEmpty():
        digit = F.substring(F.encode(item, "UTF-8"), place, TERM_DIGIT)
        bins = ties.groupBy(*by, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("k"))
        last = common.stored(_narrow(bins, by, F.col("k"), False).select(*by, F.col("digit").alias("edge"), F.col("left").alias("rest"), "n"), "edge")
        told = ties.withColumn("digit", digit).join(last, by)
        sure = told.where((F.col("digit") < F.col("edge")) | ((F.col("digit") == F.col("edge")) & (F.col("rest") == F.col("n"))))
        taken.append(sure.select(*by, F.col(item), F.col("head").alias(value)).select(*rows.columns))
        ties = common.stored(told.where((F.col("digit") == F.col("edge")) & (F.col("rest") < F.col("n"))).select(*by, item, "head", F.col("rest").alias("left")), "ties")
        place += TERM_DIGIT
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(first).alias("rank"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: sources by divergence (part pair), and terms that a source has more of than its language (part term)."""
    found = shares(docs, least_docs)
    over = found.shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(pairs(found), "pair").unionByName(_ranked(top_rows(over, ["lang", "source"], top), "term"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


#: Every kept term for every group.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (
  SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
  SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT f.lang, f.source, f.term, f.n,
         1 + (CAST(1000000000 AS HUGEINT) * (f.n + 5)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + 5 * v.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (sum(f.n) OVER (PARTITION BY f.lang, f.term) + 5)) // (sum(f.n) OVER (PARTITION BY f.lang) + 5 * v.v) AS q
  FROM f JOIN v USING (lang)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
