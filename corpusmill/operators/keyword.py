"""Keyword ranking (Okapi BM25) of many queries over many tenants at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..params import DEFAULT, Params
from ..sources import places
from .segments import counted


def tokenised(chunks: DataFrame, tokenizer=tx.words) -> DataFrame:
    """user_id, chunk_id, terms. The tokenizer is a Column function; by default words as they are written."""
    return chunks.select("user_id", "chunk_id", tokenizer(F.col("text")).alias("terms"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """user_id, n_docs, avgdl."""
    return tokens.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avgdl"))


def _exploded(rows: DataFrame, terms, *columns) -> DataFrame:
    """A row for each term. The outer form keeps the optimiser from tokenising a text once more, in the scan, to see if it has terms."""
    return rows.select(*columns, F.explode_outer(terms).alias("term")).where("term is not null")


def document_frequency(tokens: DataFrame) -> DataFrame:
    """user_id, term, df: terms are made distinct inside their row, so the shuffle sees each once."""
    return _exploded(tokens, F.array_distinct("terms"), "user_id").groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(df: DataFrame, stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """user_id, term, df, idf; a negative idf becomes a share of the tenant's mean."""
    raw = df.join(stats.select("user_id", "n_docs"), "user_id")
    raw = raw.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("user_id").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, p.idf_floor * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(mean, "user_id").select("user_id", "term", "df", idf.alias("idf"))


class Index(NamedTuple):
    """What ranking needs of the chunks: stats (user_id, n_docs, avgdl), frequency (user_id, term, df, idf), postings (user_id, term, chunk_id, dl, tf)."""

    stats: DataFrame
    frequency: DataFrame
    postings: DataFrame


def term_tables(chunks: DataFrame, p: Params = DEFAULT, tokenizer=tx.words) -> Index:
    """The index of chunks as plans, but for the numbers of chunks by term: they are counted once and kept, as idf and its mean both need them."""
    tokens = tokenised(chunks, tokenizer)
    stats = corpus_stats(tokens)
    frequency = inverse_frequency(places.kept(document_frequency(tokens), "frequency"), stats, p)
    postings = _exploded(tokens, F.col("terms"), "user_id", "chunk_id", F.size("terms").alias("dl"))
    return Index(stats, frequency, postings)


def write_index(index: Index, path: str) -> None:
    """Keep an index: a tenant is a folder, and terms are sorted, so that a search reads the row groups of its terms only."""
    postings = index.postings
    if "tf" not in postings.columns:
        postings = postings.groupBy("user_id", "term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    for name, rows in (("frequency", index.frequency), ("postings", postings)):
        rows.repartitionByRange("user_id", "term").sortWithinPartitions("user_id", "term").write.mode("overwrite").partitionBy("user_id").parquet(f"{path}/{name}")


def build_index(chunks: DataFrame, path: str, p: Params = DEFAULT, tokenizer=tx.words) -> None:
    """Keep the index of chunks. Texts are taken apart once, and a chunk's terms are counted where it lies; postings are then shuffled once, into their order."""
    rows = counted(chunks, tokenizer).select("user_id", "chunk_id", "dl", "terms")
    held = places.fresh(chunks.sparkSession, "counted")
    rows.write.parquet(held)
    rows = chunks.sparkSession.read.schema(rows.schema).parquet(held)
    stats = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    postings = rows.select("user_id", "chunk_id", "dl", F.explode("terms").alias("t")).select("user_id", "chunk_id", "dl", "t.term", "t.tf")
    frequency = inverse_frequency(postings.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df")), stats, p)
    write_index(Index(stats, frequency, postings), path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/frequency"), spark.read.parquet(f"{path}/postings"))


def keyword_topk(chunks: DataFrame, queries: DataFrame, p: Params = DEFAULT, tokenizer=tx.words, fill: bool = False, index: Index | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the best chunks of the query's tenant.

    Only chunks that share a term are ranked; with ``fill`` those without take
    the remaining ranks with score 0, by id. Query terms count as often as
    they stand in the query. Without a kept index the terms are counted anew.
    """
    terms = _exploded(queries, tokenizer(F.col("text")), "query_id", "user_id").groupBy("query_id", "user_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = terms.select("user_id", "term").distinct()
    if index is None:
        # kept, so that its size is known and few terms meet the postings where these lie, before any shuffle
        asked = places.kept(asked, "asked")
    found = index or term_tables(chunks, p, tokenizer)
    frequency = found.frequency.join(asked, ["user_id", "term"], "left_semi")
    postings = found.postings.join(asked, ["user_id", "term"], "left_semi")
    if "tf" not in postings.columns:
        postings = postings.groupBy("user_id", "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf, norm = F.col("tf"), p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avgdl"))
    weighted = postings.join(frequency, ["user_id", "term"]).join(found.stats, "user_id").select("user_id", "term", "chunk_id", (F.col("idf") * tf * (p.k1 + 1) / (tf + norm)).alias("w"))
    scored = terms.join(weighted, ["user_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))
    if fill:
        scored = scored.unionByName(_without_terms(chunks, queries, scored, p.keyword_k))
    return top(scored, F.desc(F.round("score", 9)), p.keyword_k)


def _without_terms(chunks: DataFrame, queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score 0: the first chunks by id of each query's tenant that share no term with it, k at least if there are.

    Among the first k + n chunks of a tenant at least k are none of the n that
    a query has found, so no query meets all chunks.
    """
    found = queries.select("query_id", "user_id").join(scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").withColumn("take", k + F.coalesce("n", F.lit(0)))
    most = found.agg(F.max("take")).first()[0] or k
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("chunk_id"))
    first = chunks.select("user_id", "chunk_id").withColumn("place", place).where(F.col("place") <= most)
    every = found.join(first, "user_id").where(F.col("place") <= F.col("take")).select("query_id", "chunk_id")
    return every.join(scored, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))


def top(scored: DataFrame, order, k: int) -> DataFrame:
    """The first k of each query with their rank, ties by chunk id; cut before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(order, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
