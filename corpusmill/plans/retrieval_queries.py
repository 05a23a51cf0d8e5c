"""Queries of retrieval over the supplied tables, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cells, fusion, keyword, segments, vector
from ..params import DEFAULT, Params
from ..sources import places, tables
from . import search

#: Words that the corpus has, in place of the defaults, so that every route is taken.
WORDS = Params(question_words=("that", "une", "der"), pronouns=("this", "ciónos"))
#: Distance up to which hybrid search keeps vectors of the supplied tables, whose nearest pairs lie far apart.
REACH = 0.9


def tenant_centres(vectors: DataFrame) -> DataFrame:
    """The mean vector of each tenant as its query."""
    parts = vectors.select("user_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("user_id", "i").agg(F.avg("x").alias("x"))
    rows = parts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(F.substring("user_id", 4, 20).cast("long").alias("query_id"), "user_id", F.transform("v", lambda s: s["x"]).alias("embedding"))


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return tables.queries(spark, sf_dir).join(e, "query_id", "left")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword.keyword_topk(tables.chunks(spark, sf_dir), tables.queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = keyword.tokenised(tables.chunks(spark, sf_dir))
    df = keyword.document_frequency(tokens).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("sum_df"), F.max("df").alias("max_df"))
    return keyword.corpus_stats(tokens).join(df, "user_id").select("user_id", "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "sum_df", "max_df")


def _near(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    found = vector.vector_topk(v, tenant_centres(v), threshold=threshold)
    return found.select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 0)


def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 0.8)


def vector_topk_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 50 as queries, with the default threshold."""
    v = tables.vectors(spark, sf_dir)
    asked = v.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "user_id", "embedding")
    found = vector.vector_topk(v, asked)
    return found.select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of vector_topk over cells that are written first."""
    v, path = tables.vectors(spark, sf_dir), places.fresh(spark, "cells")
    cells.write_cells(v, path)
    found = cells.cells_topk(spark, path, tenant_centres(v), threshold=0)
    return found.select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = embedded_queries(spark, sf_dir)
    words = keyword.keyword_topk(tables.chunks(spark, sf_dir), q)
    near = vector.vector_topk(tables.vectors(spark, sf_dir), q.where("embedding is not null"), threshold=0)
    return fusion.rrf(words, near).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("position").cast("long").alias("position"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid_search(tables.chunks(spark, sf_dir), tables.vectors(spark, sf_dir), embedded_queries(spark, sf_dir), threshold=REACH)
    return found.select("query_id", "strategy", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"), F.col("final_rank").cast("long").alias("final_rank"))


def hybrid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, its keyword side over an index by segments."""
    chunks, index = tables.chunks(spark, sf_dir), segments.KeywordIndex(spark, places.fresh(spark, "segments"))
    index.update(chunks)
    found = search.hybrid_search(chunks, tables.vectors(spark, sf_dir), embedded_queries(spark, sf_dir), threshold=REACH, index=index)
    return found.select("query_id", "strategy", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"), F.col("final_rank").cast("long").alias("final_rank"))


def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages; every third query is the first word of its passage alone."""
    q = embedded_queries(spark, sf_dir)
    return q.withColumn("text", F.when(F.col("query_id") % 3 == 1, F.regexp_extract("text", r"\S+", 0)).otherwise(F.col("text")))


def hybrid_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in which all three routes occur."""
    found = search.hybrid_search(tables.chunks(spark, sf_dir), tables.vectors(spark, sf_dir), routed_queries(spark, sf_dir), WORDS, threshold=REACH)
    return found.select("query_id", "strategy", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"), F.col("final_rank").cast("long").alias("final_rank"))


def bm25_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search over an index that is written first; searches read only their terms."""
    path = places.fresh(spark, "index")
    keyword.build_index(tables.chunks(spark, sf_dir), path)
    found = keyword.keyword_topk(tables.chunks(spark, sf_dir), tables.queries(spark, sf_dir), index=keyword.read_index(spark, path))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_segments_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search over an index that took the chunks in four additions, lost the toxic ones in a fifth change, and was merged."""
    index = segments.KeywordIndex(spark, places.fresh(spark, "segments"))
    chunks = tables.chunks(spark, sf_dir)
    for k in range(4):
        index.update(chunks.where(F.pmod("chunk_id", F.lit(4)) == k))
    toxic = tables.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    index.update(gone=chunks.join(toxic, "chunk_id", "left_semi"))
    index.merge()
    found = index.search(tables.queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, q = tables.chunks(spark, sf_dir), tables.queries(spark, sf_dir)
    hits = keyword.keyword_topk(chunks, q).withColumnRenamed("rank", "position").join(q.select("query_id", "user_id", F.col("text").alias("query")), "query_id").join(chunks, ["user_id", "chunk_id"])
    return fusion.rerank(hits).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("final_rank").cast("long").alias("final_rank"))


def query_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.messages(spark, sf_dir)
    return rows.select("session_id", "id", fusion.strategy(F.col("content"), WORDS).alias("strategy"), fusion.strategy(F.regexp_extract("content", r"[^ \n\t]+", 0), WORDS).alias("short_strategy"))


def rewrite_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title stands for what a model would have written; a blank or short one falls back."""
    rows = tables.messages(spark, sf_dir)
    written = F.when(F.length("content") % 3 == 0, F.lit("  x ")).otherwise(tx.title(F.col("content")))
    return rows.select("session_id", "id", F.md5(tx.accept_rewrite(F.col("content"), written)).alias("md5"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword.keyword_topk(tables.chunks(spark, sf_dir), tables.queries(spark, sf_dir), Params(keyword_k=5))
    d = tables.table(spark, sf_dir, "documents")
    images = F.array(F.concat(F.lit("extracted_images/"), F.col("lang"), F.lit("/p.png")), F.concat(F.col("source"), F.lit("\\q.png")))
    meta = d.select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit(".pdf")).alias("original_filename"), F.nullif(F.col("doc_id") % 9, F.lit(0)).cast("string").alias("page"), F.col("lang").alias("current_chapter"), "text", images.alias("image_paths"))
    return found.withColumnRenamed("rank", "final_rank").join(meta, "chunk_id")


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.contexts(_hits(spark, sf_dir)).select("query_id", F.md5("context").alias("md5"), F.length("context").cast("long").alias("n"))


def references_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.references(_hits(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.image_references(_hits(spark, sf_dir))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_corpus_stats, vector_topk, vector_topk_threshold, vector_topk_default, vector_cells_topk, rrf_fusion, hybrid_search, hybrid_segments, hybrid_routes, bm25_indexed_topk, bm25_segments_topk, rerank_topk, query_strategy, rewrite_fallback, context_blocks, references_list, image_refs)}


def words_sql(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda t: t <> '')"


_TOKENS = f"""
t AS (SELECT source AS user_id, doc_id AS chunk_id, {words_sql('text')} AS terms FROM documents),
st AS (SELECT user_id, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM t GROUP BY user_id),
df AS (SELECT user_id, term, count(*) AS df FROM (SELECT user_id, unnest(list_distinct(terms)) AS term FROM t) GROUP BY user_id, term)"""
_QUERIES = "q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS user_id, text FROM benchmark)"
_ROUTED = r"q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS user_id, CASE WHEN item_id % 3 = 1 THEN regexp_extract(text, '\S+') ELSE text END AS text FROM benchmark)"
_BM25 = f"""{_QUERIES},{_TOKENS},
i0 AS (SELECT df.*, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING (user_id)),
mi AS (SELECT user_id, avg(raw) AS mean FROM i0 GROUP BY user_id),
idf AS (SELECT user_id, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM i0 JOIN mi USING (user_id)),
qt AS (SELECT query_id, user_id, term, count(*) AS qtf FROM (SELECT query_id, user_id, unnest({words_sql('text')}) AS term FROM q) GROUP BY ALL),
po AS (SELECT user_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT user_id, chunk_id, len(terms) AS dl, unnest(terms) AS term FROM t) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(qtf * (idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) AS score
       FROM qt JOIN idf USING (user_id, term) JOIN po USING (user_id, term) JOIN st USING (user_id) GROUP BY query_id, chunk_id),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc),
kw AS (SELECT * FROM kr WHERE rank <= 10)"""
_VECTORS = "v AS (SELECT vec_id AS chunk_id, source AS user_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON vec_id = doc_id)"
_CENTRES = f"""{_VECTORS},
qv AS (SELECT CAST(substr(user_id, 4) AS BIGINT) AS query_id, user_id, list(x ORDER BY i) AS qe FROM (
         SELECT user_id, i, avg(x) AS x FROM (SELECT user_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY user_id, i) GROUP BY user_id)"""
_EMBEDDED = f"""{_VECTORS},
qv AS (SELECT query_id, q.user_id, CAST(embedding AS DOUBLE[]) AS qe FROM q JOIN embeddings ON vec_id = query_id)"""
_NEAR = """
vd AS (SELECT query_id, chunk_id, 1 - list_cosine_similarity(e, qe) AS distance FROM qv JOIN v USING (user_id)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM vd),
vk AS (SELECT * FROM vr WHERE rank <= 10)"""


def _fused(threshold: float) -> str:
    return f"""
rl AS (SELECT query_id, chunk_id, rank, 0 AS list FROM kw UNION ALL SELECT query_id, chunk_id, rank, 1 FROM vk WHERE {threshold} <= 0 OR distance <= {threshold}),
rs AS (SELECT query_id, chunk_id, sum(1.0e0 / (60 + rank)) AS rrf_score, min(list * 1000000 + rank) AS seen FROM rl GROUP BY query_id, chunk_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, seen) AS position FROM rs)"""


def _reranked(hits: str) -> str:
    return f"""
ov AS (SELECT h.*, round(CAST(len(list_intersect(list_distinct({words_sql('lower(q.text)')}), {words_sql('lower(d.text[1:512])')})) AS DOUBLE)
         / greatest(len(list_distinct({words_sql('lower(q.text)')})), 1), 9) AS rerank_score
       FROM {hits} h JOIN q USING (query_id) JOIN documents d ON d.doc_id = h.chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS final_rank FROM ov)"""


_NEAR_OUT = "SELECT query_id, chunk_id, round(distance, 5) AS distance, rank FROM vk"
_HITS = f"""{_BM25},
hi AS (SELECT query_id, chunk_id, rank AS final_rank, source || '.pdf' AS original_filename, CAST(nullif(doc_id % 9, 0) AS VARCHAR) AS page, lang AS current_chapter, text,
         'extracted_images/' || lang || '/p.png' AS i1, source || chr(92) || 'q.png' AS i2
       FROM kw JOIN documents ON doc_id = chunk_id WHERE rank <= 5)"""
_CLASS = "CASE WHEN NOT asks AND length(bare) <= 10 THEN 'bm25_only' WHEN asks THEN 'hybrid_rewritten' ELSE 'hybrid' END"


def _strategy_sql(c: str) -> str:
    bare = f"replace(trim({c}), ' ', '')"
    asks = "(" + " OR ".join(f"contains({bare}, '{w}')" for w in (*WORDS.question_words, *WORDS.pronouns)) + ")"
    return _CLASS.replace("asks", asks).replace("bare", bare)


ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw",
    "bm25_corpus_stats": f"WITH {_TOKENS.strip()}, g AS (SELECT user_id, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS sum_df, max(df) AS max_df FROM df GROUP BY user_id) SELECT user_id, n_docs, round(avgdl, 6) AS avgdl, n_terms, sum_df, max_df FROM st JOIN g USING (user_id)",
    "vector_topk": f"WITH {_CENTRES},{_NEAR} {_NEAR_OUT}",
    "vector_cells_topk": f"WITH {_CENTRES},{_NEAR} {_NEAR_OUT}",
    "vector_topk_threshold": f"WITH {_CENTRES},{_NEAR} {_NEAR_OUT} WHERE distance <= 0.8",
    "vector_topk_default": f"WITH {_VECTORS}, qv AS (SELECT chunk_id AS query_id, user_id, e AS qe FROM v WHERE chunk_id % 50 = 0),{_NEAR} {_NEAR_OUT} WHERE distance <= 0.45",
    "bm25_indexed_topk": f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw",
    "bm25_segments_topk": f"WITH {_BM25.replace('FROM documents', 'FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw",
    "hybrid_routes": f"WITH {_BM25.replace(_QUERIES, _ROUTED)},{_EMBEDDED[:-1]} WHERE {_strategy_sql('q.text')} <> 'bm25_only'),{_NEAR},{_fused(REACH)},{_reranked('rr')} SELECT query_id, {_strategy_sql('q.text')} AS strategy, chunk_id, round(rrf_score, 9) AS rrf_score, round(rerank_score, 6) AS rerank_score, final_rank FROM fr JOIN q USING (query_id) WHERE final_rank <= 5",
    "rrf_fusion": f"WITH {_BM25},{_EMBEDDED},{_NEAR},{_fused(0)} SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, position FROM rr",
    "hybrid_search": f"WITH {_BM25},{_EMBEDDED},{_NEAR},{_fused(REACH)},{_reranked('rr')} SELECT query_id, 'hybrid' AS strategy, chunk_id, round(rrf_score, 9) AS rrf_score, round(rerank_score, 6) AS rerank_score, final_rank FROM fr WHERE final_rank <= 5",
    "hybrid_segments": f"WITH {_BM25},{_EMBEDDED},{_NEAR},{_fused(REACH)},{_reranked('rr')} SELECT query_id, 'hybrid' AS strategy, chunk_id, round(rrf_score, 9) AS rrf_score, round(rerank_score, 6) AS rerank_score, final_rank FROM fr WHERE final_rank <= 5",
    "rerank_topk": f"WITH {_BM25}, kp AS (SELECT *, rank AS position FROM kw),{_reranked('kp')} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, final_rank FROM fr WHERE final_rank <= 5",
    "query_strategy": f"SELECT conv_id AS session_id, turn AS id, {_strategy_sql('text')} AS strategy, {_strategy_sql("regexp_extract(text, '[^ \\n\\t]+')")} AS short_strategy FROM conversations",
    "rewrite_fallback": "SELECT conv_id AS session_id, turn AS id, md5(CASE WHEN length(text) % 3 = 0 OR length(regexp_replace(r, '^\\s+|\\s+$', '', 'g')) < 3 THEN text ELSE regexp_replace(r, '^\\s+|\\s+$', '', 'g') END) AS md5 FROM (SELECT *, CASE WHEN length(text) > 20 THEN text[1:20] || '...' ELSE text END AS r FROM conversations)",
    "context_blocks": f"WITH {_HITS}, b AS (SELECT query_id, string_agg('[来源: ' || original_filename || coalesce(', 第' || page || '页', '') || ', ' || current_chapter || ']' || chr(10) || text[1:500], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank) AS c FROM hi GROUP BY query_id) SELECT query_id, md5(c) AS md5, length(c) AS n FROM b",
    "references_list": f"WITH {_HITS}, l AS (SELECT query_id, final_rank, original_filename || coalesce(' (第' || page || '页)', '') || ' [' || current_chapter || ']' AS label, original_filename AS source, coalesce(page, '') AS page, current_chapter AS chapter FROM hi), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY final_rank) = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, coalesce(TRY_CAST(page AS INTEGER), 0), final_rank) AS position, label, source, page, chapter FROM o",
    "image_refs": f"WITH {_HITS}, u AS (SELECT query_id, final_rank, original_filename, unnest([i1, i2]) AS raw, unnest([0, 1]) AS n FROM hi), p AS (SELECT *, CASE WHEN starts_with(replace(raw, chr(92), '/'), 'extracted_images/') THEN substr(replace(raw, chr(92), '/'), 18) ELSE replace(raw, chr(92), '/') END AS path FROM u) SELECT query_id, path, '![' || original_filename || '](http://127.0.0.1:8000/images/' || path || ')' AS markdown FROM p QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY final_rank, n) = 1",
}
