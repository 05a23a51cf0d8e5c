"""The retrieval plan: route, rank, fuse, rank again, for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as tx
from ..operators import fusion, keyword, segments, vector
from ..params import DEFAULT, Params
from ..sources import places


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    p: Params = DEFAULT,
    scorer: Callable[[Column, Column], Column] | None = fusion.overlap_score,
    threshold: float | None = None,
    index: keyword.Index | segments.KeywordIndex | None = None,
    rewriter: plugins.Rewriter = plugins.keep_query,
    embedder: plugins.Embedder | None = None,
) -> DataFrame:
    """query_id, strategy, chunk_id, rrf_score, rerank_score, final_rank.

    queries: (query_id, user_id, text), and history where the rewriter wants
    it. Queries that ask or point at something are rewritten; a blank or short
    result falls back to the query. The vector side searches by the embedder's
    vector of that text, or without an embedder by the column embedding that
    callers supply. Bare keywords never reach the vector side; the keyword side
    and the second ranking always see the original text. Queries without a
    tenant have no results. The keyword side searches a kept index where it is
    given one (an index by segments with its own settings), else it counts the
    chunks' terms anew.
    """
    asked = queries.where(F.coalesce("user_id", F.lit("")) != "").withColumn("strategy", fusion.strategy(F.col("text"), p))
    if embedder is not None:
        past = F.col("history") if "history" in queries.columns else F.lit(None).cast("string")
        written = F.when(F.col("strategy") == "hybrid_rewritten", tx.accept_rewrite(F.col("text"), rewriter(F.col("text"), past), p)).otherwise(F.col("text"))
        seen = asked.where("strategy <> 'bm25_only'").select("query_id", written.alias("text"))
        asked = asked.drop("embedding").join(plugins.embed(seen, embedder, p).select("query_id", "embedding"), "query_id", "left")
    words = index.search(asked) if isinstance(index, segments.KeywordIndex) else keyword.keyword_topk(chunks, asked, p, index=index)
    near = vector.vector_topk(vectors, asked.where((F.col("strategy") != "bm25_only") & F.col("embedding").isNotNull()), p, threshold)
    fused = fusion.rrf(words, near, p).join(asked.select("query_id", "user_id", "strategy", F.col("text").alias("query")), "query_id")
    # kept, so that few results meet the texts where these lie and no text is shuffled
    hits = places.kept(fused, "fused").join(chunks.select("user_id", "chunk_id", "text"), ["user_id", "chunk_id"])
    return fusion.rerank(hits, p, scorer)


def contexts(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, context: the blocks of the results in order. hits: (query_id, final_rank, original_filename, page, current_chapter, text)."""
    block = tx.context_block(F.col("original_filename"), F.col("page"), F.col("current_chapter"), F.col("text"), p)
    blocks = F.sort_array(F.collect_list(F.struct("final_rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n---\n\n").alias("context"))


def references(hits: DataFrame) -> DataFrame:
    """query_id, label, source, page, chapter: distinct labels, sorted by source and first page. hits as for contexts."""
    page = F.coalesce(F.col("page").cast("string"), F.lit(""))
    rows = hits.select("query_id", "final_rank", tx.reference_label(F.col("original_filename"), F.col("page"), F.col("current_chapter")).alias("label"), F.coalesce("original_filename", F.lit("未知")).alias("source"), page.alias("page"), F.coalesce("current_chapter", F.lit("")).alias("chapter"))
    first = Window.partitionBy("query_id", "label").orderBy("final_rank")
    kept = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("source", F.coalesce(F.expr("try_cast(regexp_extract(page, '^[0-9]+', 0) AS INT)"), F.lit(0)), "final_rank")
    return kept.select("query_id", F.row_number().over(order).alias("position"), "label", "source", "page", "chapter")


def image_references(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """query_id, path, markdown of the distinct images of the results, in order. hits: (query_id, final_rank, original_filename, image_paths)."""
    rows = hits.select("query_id", "final_rank", "original_filename", F.posexplode("image_paths").alias("n", "raw"))
    rows = rows.select("query_id", "final_rank", "n", tx.image_path(F.col("raw"), p).alias("path"), tx.image_markdown(F.col("original_filename"), F.col("raw"), p).alias("markdown"))
    first = Window.partitionBy("query_id", "path").orderBy("final_rank", "n")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("query_id", "path", "markdown")
