"""Fusion of ranked lists, second ranking, and the choice of lists by query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..params import DEFAULT, Params


def rrf(keyword: DataFrame, vector: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, chunk_id, rrf_score, position out of two lists with (query_id, chunk_id, rank).

    A list adds 1 / (constant + rank); ties keep the order in which a reader of
    the keyword list and then of the vector list meets the chunks.
    """
    tagged = keyword.select("query_id", "chunk_id", "rank", F.lit(0).alias("list")).unionByName(vector.select("query_id", "chunk_id", "rank", F.lit(1).alias("list")))
    fused = tagged.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (p.rrf_constant + F.col("rank"))).alias("rrf_score"), F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("seen")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "seen")
    return fused.withColumn("position", F.row_number().over(w)).drop("seen")


def query_class(q: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """(asks or points at something, is a bare keyword)."""
    bare = F.replace(F.trim(q), F.lit(" "), F.lit(""))
    asks = F.lit(False)
    for w in (*p.question_words, *p.pronouns):
        asks = asks | F.contains(bare, F.lit(w))
    return asks, ~asks & (F.length(bare) <= p.keyword_max_len)


def strategy(q: Column, p: Params = DEFAULT) -> Column:
    asks, bare = query_class(q, p)
    return F.when(bare, "bm25_only").when(asks, "hybrid_rewritten").otherwise("hybrid")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the distinct query terms that the text has: the default where no model scores pairs."""
    terms = F.array_distinct(tx.words(F.lower(query)))
    both = F.size(F.array_intersect(terms, tx.words(F.lower(text))))
    return both.cast("double") / F.greatest(F.size(terms), F.lit(1))


def rerank(hits: DataFrame, p: Params = DEFAULT, scorer: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """hits: (query_id, chunk_id, position, query, text). The best by score, ties by position; without a scorer the first ones."""
    score = scorer(F.col("query"), F.substring("text", 1, p.rerank_chars)) if scorer else F.lit(None).cast("double")
    scored = hits.withColumn("rerank_score", F.round(score, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "position")
    return scored.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= p.final_k)
