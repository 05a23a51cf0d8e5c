"""Queries of the smaller operators, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as tx
from ..operators import layout
from ..operators import management as mg
from ..sources import tables


def page_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    pages = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), (n > 700).alias("has_text"), F.array(F.struct((n % 60).alias("w"), (n % 45).alias("h"))).alias("images"))
    return layout.type_histogram(pages).withColumnRenamed("file_id", "source")


def page_type_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("scan_pdf")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(layout.page_types_or_text(known, (F.col("n_chars") % 3 + 1).cast("int")), ",").alias("types"))


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.struct((F.col("n_chars") % 7).alias("y"), F.col("lang").alias("text")), F.struct((F.col("n_chars") % 5).alias("y"), F.col("source").alias("text")), F.struct(F.lit(3).cast("long").alias("y"), F.lit(" ").alias("text")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", layout.scanned_page(parts).alias("page"))


def caption_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are events of a file, alike if of one type; the cache knows views and clicks by their value."""
    e = tables.table(spark, sf_dir, "events")
    images = e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 10).cast("string")).alias("path"))
    first = e.groupBy(F.col("user_id").alias("file_id"), "event_type").agg(F.min("event_id").alias("rep_seq"))
    groups = e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), "event_type").join(first, ["file_id", "event_type"]).drop("event_type")
    cache = images.where(F.col("path").endswith("/1") | F.col("path").endswith("/2")).select("path", F.concat(F.lit("cap "), "path").alias("caption")).distinct()
    return layout.captioned(images, cache, groups).select("file_id", "seq", "caption")


def caption_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return plugins.caption_summary(e.select(F.col("user_id").alias("file_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("caption")))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.messages(spark, sf_dir)
    return m.groupBy("session_id").agg(F.min_by("content", "id").alias("first_query"), F.count(F.lit(1)).alias("n"))


def new_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _sessions(spark, sf_dir).select("session_id", F.lit("u").alias("user_id"), "first_query", F.lit("2024-05-01T00:00:00").alias("now"))
    return mg.create_conversations(new)


def touch_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    c = s.select("session_id", F.lit("old").alias("last_chat_time"))
    return mg.touch(c, s.where("n > 5").select("session_id", F.lit("new").alias("now")))


def pin_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _sessions(spark, sf_dir).select("session_id", F.lit(0).alias("is_top"), F.lit("t").alias("session_title"))
    return mg.rename(mg.toggle_pin(c, 3, 1), 4, "a name that is longer than twenty")


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir).select("session_id", "n")
    return mg.merge_pages(s.where("n <= 6"), s.where("n >= 5"))


def cancel_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return mg.cancel_tasks(e.select(F.col("event_id").alias("task_id"), state.alias("status")))


def set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    one = d.select(F.md5("text").alias("md5"))
    two = one.unionByName(tables.queries(spark, sf_dir).select(F.md5("text").alias("md5")))
    return mg.changed(one, two)


def cosine_to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .retrieval_queries import tenant_centres

    v = tables.vectors(spark, sf_dir)
    centre = tenant_centres(v).select("user_id", F.col("embedding").alias("centre"))
    return v.join(centre, "user_id").select("chunk_id", F.round(tx.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", tx.hamming(F.col("event_id"), F.col("user_id")).cast("long").alias("distance"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = tx.scaled_size(F.col("n_chars"), F.col("n_chars") % 977 + 1)
    return tables.table(spark, sf_dir, "documents").select("doc_id", size.alias("s")).select("doc_id", "s.width", "s.height")


def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", tx.time_stamp(F.col("ts")).alias("stamp"))


def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 2 == 0, F.lit("ask: {query} ({n})")).otherwise(F.lit("{query} {missing}"))
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.fill_template(t, {"query": F.col("role"), "n": F.col("turn").cast("string")})).alias("md5"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("e"))
    return e.select("user_id", F.array_join(F.transform(mg.last_lines(F.col("e")), lambda x: x.cast("string")), ",").alias("tail"))


def list_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    return s.select("session_id", tx.display_title(F.when(F.col("n") > 5, F.lit("")).otherwise(tx.title(F.col("first_query"))), F.lit("未命名")).alias("title"))


def summary_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.summary_bypass(F.col("text"))).alias("md5"))


QUERIES = {
    f.__name__: f
    for f in (
        page_type_histogram, page_type_fallback, scanned_pages, caption_reuse, caption_summary, new_conversations, touch_conversations, pin_conversations, next_page, cancel_tasks, set_changes,
        cosine_to_centre, hash_distance, image_sizes, time_stamps, prompt_fill, log_tail, list_titles, summary_bypass,
    )
}

_KIND = "CASE WHEN n_chars > 700 AND n_chars % 60 > 30 AND n_chars % 45 > 30 THEN 'text_mix_pdf' WHEN n_chars % 60 > 30 AND n_chars % 45 > 30 THEN 'scan_pdf' ELSE 'text_pdf' END"
_SESSIONS = "s AS (SELECT conv_id AS session_id, arg_min(text, turn) AS first_query, count(*) AS n FROM conversations GROUP BY conv_id)"
_TITLE = "CASE WHEN length(first_query) > 20 THEN first_query[1:20] || '...' ELSE first_query END"

ORACLES = {
    "page_type_histogram": f"SELECT source, {_KIND} AS page_type, count(*) AS n FROM documents GROUP BY 1, 2",
    "page_type_fallback": "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'scan_pdf' ELSE array_to_string(list_transform(range(0, n_chars % 3 + 1), lambda i: 'text_pdf'), ',') END AS types FROM documents",
    "scanned_pages": "SELECT doc_id, CASE WHEN (n_chars % 7, lang) <= (n_chars % 5, source) THEN lang || chr(10) || source ELSE source || chr(10) || lang END AS page FROM documents",
    "caption_reuse": "WITH i AS (SELECT user_id AS file_id, event_id AS seq, event_type || '/' || (event_id % 10) AS path, min(event_id) OVER (PARTITION BY user_id, event_type) AS rep FROM events), "
    "c AS (SELECT *, CASE WHEN seq % 10 IN (1, 2) THEN 'cap ' || path END AS caption FROM i) SELECT a.file_id, a.seq, coalesce(a.caption, b.caption) AS caption FROM c a JOIN c b ON b.file_id = a.file_id AND b.seq = a.rep",
    "caption_summary": "SELECT user_id AS file_id, count(*) AS total, count_if(event_type <> 'error')::BIGINT AS ok, count_if(event_type = 'error')::BIGINT AS degraded FROM events GROUP BY user_id",
    "new_conversations": f"WITH {_SESSIONS} SELECT session_id, 'u' AS user_id, {_TITLE} AS session_title, 0 AS is_top, '2024-05-01T00:00:00' AS last_chat_time, '2024-05-01T00:00:00' AS created_at FROM s",
    "touch_conversations": f"WITH {_SESSIONS} SELECT session_id, CASE WHEN n > 5 THEN 'new' ELSE 'old' END AS last_chat_time FROM s",
    "pin_conversations": f"WITH {_SESSIONS} SELECT session_id, CAST(session_id = 3 AS INTEGER) AS is_top, CASE WHEN session_id = 4 THEN 'a name that is longe...' ELSE 't' END AS session_title FROM s",
    "next_page": f"WITH {_SESSIONS} SELECT session_id, n FROM s",
    "cancel_tasks": "SELECT event_id AS task_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events",
    "set_changes": "SELECT md5(text) AS md5 FROM benchmark",
    "cosine_to_centre": "WITH v AS (SELECT vec_id AS chunk_id, source AS user_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON vec_id = doc_id), "
    "q AS (SELECT user_id, list(x ORDER BY i) AS c FROM (SELECT user_id, i, avg(x) AS x FROM (SELECT user_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY user_id, i) GROUP BY user_id) "
    "SELECT chunk_id, round(list_cosine_similarity(e, c), 6) AS cosine FROM v JOIN q USING (user_id)",
    "hash_distance": "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS BIGINT) AS distance FROM events",
    "image_sizes": "WITH s AS (SELECT doc_id, n_chars AS w, n_chars % 977 + 1 AS h, least(1.0e0, 2048.0e0 / greatest(n_chars, n_chars % 977 + 1)) AS r FROM documents) SELECT doc_id, CAST(greatest(1, floor(w * r)) AS INTEGER) AS width, CAST(greatest(1, floor(h * r)) AS INTEGER) AS height FROM s",
    "time_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events",
    "prompt_fill": "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'ask: ' || role || ' (' || turn || ')' ELSE '{query} {missing}' END) AS md5 FROM conversations",
    "log_tail": "SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS tail FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10) GROUP BY user_id",
    "list_titles": f"WITH {_SESSIONS} SELECT session_id, CASE WHEN n > 5 THEN '未命名' ELSE {_TITLE} END AS title FROM s",
    "summary_bypass": "SELECT doc_id, md5(CASE WHEN length(text) < 500 THEN text ELSE text[1:500] || '...' END) AS md5 FROM documents",
}
