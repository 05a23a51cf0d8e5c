"""Queries of catalogue, conversations, tasks and streams, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import layout
from ..operators import management as mg
from ..params import Params
from ..sources import tables
from ..streaming import events as ev
from ..streaming import keyed


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("user_id"), F.md5("text").alias("md5"), F.col("doc_id").alias("chunk_index"), F.concat(F.lit("f"), F.col("n_chars").cast("string")).alias("original_filename"), F.col("lang").alias("created_at"))


def document_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.catalogue(_store(spark, sf_dir))


def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger knows the labelled documents, and passages that the store does not have."""
    known = _store(spark, sf_dir).join(tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_index")), "chunk_index").select("user_id", "md5")
    other = tables.queries(spark, sf_dir).select("user_id", F.md5("text").alias("md5"))
    return mg.reconcile(_store(spark, sf_dir), known.unionByName(other))


def _labelled(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return _store(spark, sf_dir).join(tables.table(spark, sf_dir, "labels").where(condition).select(F.col("doc_id").alias("chunk_index")), "chunk_index")


def delete_by_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.without(_store(spark, sf_dir), _labelled(spark, sf_dir, "toxic = 1"), ["user_id", "md5"]).select("user_id", "md5", "chunk_index")


def delete_by_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir)
    gone = rows.join(_labelled(spark, sf_dir, "quality = 0").select("original_filename").distinct(), "original_filename", "left_semi")
    return mg.without(rows, gone, ["user_id", "md5"]).select("user_id", "md5", "chunk_index")


def clear_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.without(_store(spark, sf_dir), spark.createDataFrame([("src0",)], "user_id string"), ["user_id"]).select("user_id", "md5", "chunk_index")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents go from chunks, ledger and images (one for each chunk); the ledger lacks two tenants, whose images are orphans."""
    store = _store(spark, sf_dir)
    ledger = store.where("user_id not in ('src1', 'src2')").select("user_id", "md5").distinct()
    images = store.select("user_id", "md5", F.concat_ws("/", "user_id", "chunk_index").alias("path"))
    chunks, left, kept = mg.cascade(store, ledger, images, _labelled(spark, sf_dir, "toxic = 1"))
    tell = lambda df, what: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "user_id", "n")
    return tell(chunks, "chunks").unionByName(tell(left, "ledger")).unionByName(tell(kept, "images")).unionByName(tell(mg.orphan_images(kept, left), "orphans")).unionByName(tell(mg.listed(chunks, left), "listed"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents come again under another name."""
    new = _labelled(spark, sf_dir, "toxic = 1").withColumn("original_filename", F.lit("again"))
    return mg.upsert(_store(spark, sf_dir), new, ["chunk_index"]).select("chunk_index", "original_filename")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.messages(spark, sf_dir)
    per = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("c"))
    when = F.format_string("2024-01-%02dT00:%02d:00", F.col("c") % 28 + 1, F.col("n") % 60)
    return per.select("session_id", F.concat(F.lit("u"), (F.col("session_id") % 5).cast("string")).alias("user_id"), F.when(F.col("c") % 2 == 0, "named").otherwise("").alias("session_title"), (F.col("c") % 7 == 0).cast("int").alias("is_top"), when.alias("last_chat_time"), F.lit("2024-01-01T00:00:00").alias("created_at"))


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.conversation_pages(_conversations(spark, sf_dir)).select("user_id", "session_id", "session_title", "is_top", "last_chat_time", "place", "page")


def conversation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).where("user_id = 'u1'")
    return mg.conversation_page(rows, offset=3, limit=7).select("session_id", "session_title", "is_top", "last_chat_time")


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.context_window(tables.messages(spark, sf_dir)).select("session_id", "id", "type", F.md5("content").alias("md5"))


def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.messages(spark, sf_dir).select("session_id", "id", tx.title(F.col("content")).alias("title"), tx.preview(F.col("content"), 30).alias("preview"))


def title_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.backfill_titles(_conversations(spark, sf_dir), tables.messages(spark, sf_dir)).select("session_id", "session_title")


def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.session_history(tables.messages(spark, sf_dir)).select("session_id", F.md5("history").alias("md5"), F.length("history").cast("long").alias("n"))


def simple_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = mg.session_history(tables.messages(spark, sf_dir))
    return h.select("session_id", F.md5(tx.simple_rewrite(F.lit("and then?"), F.col("history"))).alias("md5"))


def append_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session gets one more question and answer."""
    c, m = _conversations(spark, sf_dir), tables.messages(spark, sf_dir)
    new = c.select("session_id", F.lit("a question that is long enough to be cut").alias("human"), F.lit("an answer").alias("ai"), F.lit("2025-01-01T00:00:00").alias("now"))
    conv, msg = mg.append_exchange(c, m, new)
    n = msg.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))
    return conv.join(n, "session_id").select("session_id", "session_title", "last_chat_time", "n", "last_id")


def conversation_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that stay when the pinned conversations go."""
    return mg.without(tables.messages(spark, sf_dir), _conversations(spark, sf_dir).where("is_top = 1"), ["session_id"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages, every fifth of them damaged."""
    m = tables.messages(spark, sf_dir)
    stored = m.select("session_id", "id", F.when(F.col("id") % 5 == 4, F.concat(F.lit("{bad "), "content")).otherwise(mg.encode_message(F.col("type"), F.col("content"))).alias("message"))
    return mg.decode_messages(stored).select("session_id", "id", "type", F.md5("content").alias("md5"))


def role_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.messages(spark, sf_dir).select("session_id", "id", mg.chat_role(F.col("type")).alias("role"))


#: What event types stand for as results of files, and as stages.
STATUS = {"click": "done", "view": "duplicate", "purchase": "degraded", "signup": "ok", "error": "broken"}
STAGE = {"click": "hashing", "view": "loading", "purchase": "cleaning", "signup": "embedding", "error": "other"}


def _mapped(c, m: dict[str, str]):
    out = None
    for k, v in m.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    results = e.select(F.col("user_id").alias("task_id"), _mapped(F.col("event_type"), STATUS).alias("status"))
    totals = e.groupBy(F.col("user_id").alias("task_id")).agg((F.count(F.lit(1)) + F.col("task_id") % 3).alias("total"))
    return mg.task_progress(results, totals)


def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), _mapped(F.col("event_type"), STATUS).alias("status"))
    return mg.error_details(e).select("task_id", F.array_join(F.transform("details", lambda s: F.concat_ws(":", s["seq"], s["status"])), ",").alias("details"))


def degradation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.create_map("event_type", (F.col("event_id") % 4).cast("int")).alias("counts"))
    merged = layout.merge_degradation(e)
    return merged.select("file_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda s: F.concat_ws("=", s["key"], s["value"])), ",").alias("counts"))


def tool_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "web_search").otherwise(F.col("event_type")).alias("tool"))
    return mg.tool_calls(e)


def stage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", mg.stage_percent(_mapped(F.col("event_type"), STAGE)).alias("percent"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 6 == 0, F.lit(": ping")).when(F.col("event_id") % 6 == 1, F.lit("data: {broken")).otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("data")))))
    return mg.event_lines(e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), line.alias("line"))).select("task_id", "seq", "event", "data")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    kept = T.StructType([f for f in schema.fields if f.name != "props"])
    return spark.readStream.schema(kept).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run_to_table(ev.progress(_event_stream(spark, sf_dir)), "stream_progress", "complete")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run_to_table(ev.windows(_event_stream(spark, sf_dir)), "stream_windows", "complete").select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many (task, type) uploads are in flight, each counted once."""
    held = _event_stream(spark, sf_dir).select("user_id", F.col("event_type").alias("md5"), F.col("ts").cast("timestamp").alias("ts"))
    return ev.run_to_table(ev.first_uploads(held, "3650 days"), "stream_dedup", "append").select("user_id", "md5")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the whole table, as a batch run of the stream's plan."""
    e = tables.table(spark, sf_dir, "events")
    return ev.sessions(e).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


def stream_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's events wait in a queue of four, which its purchases read."""
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), (F.col("event_type") == "purchase").alias("reads"))
    return ev.run_to_table(keyed.bounded(events, Params(queue_size=4)), "stream_bounded", "append")


def stream_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tasks that ended as no event came in time; those that the watermark has not passed are under way."""
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("task_id"), "ts")
    return ev.run_to_table(keyed.timed_out(events), "stream_timeouts", "append").select("task_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        document_catalogue, ledger_reconcile, cascade_delete, delete_by_md5, delete_by_filename, clear_user, upsert_chunks, conversation_list, conversation_page, context_window, session_title, title_backfill, history_text,
        simple_rewrite, append_exchange, conversation_delete, message_json, role_remap, task_progress, error_details, degradation_merge, tool_limit, stage_percent, event_lines, stream_progress,
        stream_windows, stream_dedup, stream_sessions, stream_bounded, stream_timeouts,
    )
}

_STORE = "s AS (SELECT source AS user_id, md5(text) AS md5, doc_id AS chunk_index, 'f' || n_chars AS original_filename, lang AS created_at FROM documents)"
_CONV = "c AS (SELECT conv_id AS session_id, 'u' || (conv_id % 5) AS user_id, CASE WHEN sum(length(text)) % 2 = 0 THEN 'named' ELSE '' END AS session_title, CAST(sum(length(text)) % 7 = 0 AS INTEGER) AS is_top, printf('2024-01-%02dT00:%02d:00', CAST(sum(length(text)) % 28 + 1 AS BIGINT), count(*) % 60) AS last_chat_time FROM conversations GROUP BY conv_id)"
_MSG = "m AS (SELECT conv_id AS session_id, turn AS id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, text AS content FROM conversations)"
_WINDOW = f"{_MSG}, w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 10), k AS (SELECT * FROM w WHERE type IN ('human', 'ai'))"
_HISTORY = f"{_WINDOW}, h AS (SELECT session_id, string_agg(CASE type WHEN 'human' THEN '用户' ELSE '助手' END || ': ' || regexp_replace(content, '\\[文档\\d+\\]', '', 'g'), chr(10) ORDER BY id) AS history FROM k GROUP BY session_id)"
_ORDER = "ORDER BY is_top DESC, last_chat_time DESC, session_id"
_TITLE = "CASE WHEN length({0}) > 20 THEN {0}[1:20] || '...' ELSE {0} END"


def _case(c: str, m: dict[str, object]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in m.items()) + " END"


_PERCENT = {k: dict(mg.STAGES).get(v, 0.3) for k, v in STAGE.items()}

ORACLES = {
    "document_catalogue": f"WITH {_STORE} SELECT user_id, md5, arg_min(original_filename, chunk_index) AS original_filename, arg_min(created_at, chunk_index) AS upload_time, count(*) AS n_chunks FROM s GROUP BY user_id, md5",
    "ledger_reconcile": f"WITH {_STORE}, l AS (SELECT user_id, md5 FROM s JOIN labels ON doc_id = chunk_index UNION SELECT 'src' || (item_id % 20), md5(text) FROM benchmark), d AS (SELECT DISTINCT user_id, md5 FROM s) "
    "SELECT *, 'backfill' AS action FROM (FROM d EXCEPT FROM l) UNION ALL SELECT *, 'purge' FROM (FROM l EXCEPT FROM d)",
    "cascade_delete": f"WITH {_STORE}, g AS (SELECT DISTINCT user_id, md5 FROM s JOIN labels ON doc_id = chunk_index WHERE toxic = 1), c AS (SELECT * FROM s WHERE (user_id, md5) NOT IN (SELECT (user_id, md5) FROM g)), "
    "l AS (SELECT DISTINCT user_id, md5 FROM c WHERE user_id NOT IN ('src1', 'src2')), "
    "a AS (SELECT 'chunks' AS what, user_id FROM c UNION ALL SELECT 'ledger', user_id FROM l UNION ALL SELECT 'images', user_id FROM c UNION ALL SELECT 'orphans', user_id FROM c WHERE user_id IN ('src1', 'src2') UNION ALL SELECT 'listed', user_id FROM c WHERE user_id NOT IN ('src1', 'src2')) "
    "SELECT what, user_id, count(*) AS n FROM a GROUP BY what, user_id",
    "delete_by_md5": f"WITH {_STORE} SELECT user_id, md5, chunk_index FROM s WHERE (user_id, md5) NOT IN (SELECT (user_id, md5) FROM s JOIN labels ON doc_id = chunk_index WHERE toxic = 1)",
    "delete_by_filename": f"WITH {_STORE}, g AS (SELECT DISTINCT user_id, md5 FROM s WHERE original_filename IN (SELECT original_filename FROM s JOIN labels ON doc_id = chunk_index WHERE quality = 0)) SELECT user_id, md5, chunk_index FROM s ANTI JOIN g USING (user_id, md5)",
    "clear_user": f"WITH {_STORE} SELECT user_id, md5, chunk_index FROM s WHERE user_id <> 'src0'",
    "upsert_chunks": f"WITH {_STORE} SELECT chunk_index, CASE WHEN toxic = 1 THEN 'again' ELSE original_filename END AS original_filename FROM s LEFT JOIN labels ON doc_id = chunk_index",
    "conversation_list": f"WITH {_CONV}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id {_ORDER}) - 1 AS place FROM c) SELECT user_id, session_id, session_title, is_top, last_chat_time, place, place // 20 AS page FROM p",
    "conversation_page": f"WITH {_CONV} SELECT session_id, session_title, is_top, last_chat_time FROM c WHERE user_id = 'u1' {_ORDER} LIMIT 7 OFFSET 3",
    "context_window": f"WITH {_WINDOW} SELECT session_id, id, type, md5(content) AS md5 FROM k",
    "session_title": f"SELECT conv_id AS session_id, turn AS id, {_TITLE.format('text')} AS title, replace(text[1:30], chr(10), ' ') AS preview FROM conversations",
    "title_backfill": f"WITH {_CONV}, {_MSG}, f AS (SELECT session_id, arg_min(content, id) AS first FROM m GROUP BY session_id) SELECT session_id, CASE WHEN session_title = '' THEN {_TITLE.format('first')} ELSE session_title END AS session_title FROM c JOIN f USING (session_id)",
    "history_text": f"WITH {_HISTORY} SELECT session_id, md5(history) AS md5, length(history) AS n FROM h",
    "simple_rewrite": f"WITH {_HISTORY} SELECT session_id, md5('对话历史：' || history || chr(10) || '当前问题：and then?') AS md5 FROM h",
    "append_exchange": f"WITH {_CONV}, n AS (SELECT conv_id AS session_id, count(*) + 2 AS n, max(turn) + 2 AS last_id FROM conversations GROUP BY conv_id) SELECT session_id, CASE WHEN session_title = '' THEN 'a question that is l...' ELSE session_title END AS session_title, '2025-01-01T00:00:00' AS last_chat_time, n, last_id FROM c JOIN n USING (session_id)",
    "conversation_delete": f"WITH {_CONV}, {_MSG} SELECT session_id, count(*) AS n FROM m WHERE session_id NOT IN (SELECT session_id FROM c WHERE is_top = 1) GROUP BY session_id",
    "message_json": f"WITH {_MSG} SELECT session_id, id, CASE WHEN id % 5 = 4 THEN 'unknown' ELSE type END AS type, md5(CASE WHEN id % 5 = 4 THEN '{{bad ' || content ELSE content END) AS md5 FROM m",
    "role_remap": "SELECT conv_id AS session_id, turn AS id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role FROM conversations",
    "task_progress": "WITH e AS (SELECT user_id AS task_id, count(*) AS n, count_if(event_type IN ('click', 'purchase', 'signup'))::BIGINT AS success, count_if(event_type = 'view')::BIGINT AS skipped, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type = 'purchase')::BIGINT AS degraded_files FROM events GROUP BY user_id) "
    "SELECT task_id, n + task_id % 3 AS total, success, skipped, failed, degraded_files, success > 0 AS any_success, task_id % 3 AS pending FROM e",
    "error_details": f"SELECT user_id AS task_id, string_agg(event_id || ':' || {_case('event_type', STATUS)}, ',' ORDER BY event_id) AS details FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id",
    "degradation_merge": "WITH e AS (SELECT user_id, event_type, sum(event_id % 4) AS n FROM events GROUP BY user_id, event_type) SELECT user_id AS file_id, string_agg(event_type || '=' || CAST(n AS BIGINT), ',' ORDER BY event_type) AS counts FROM e GROUP BY user_id",
    "tool_limit": "WITH e AS (SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 'web_search' ELSE event_type END AS tool FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY session_id, tool ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n_call, CAST(CASE WHEN tool = 'web_search' THEN 2 ELSE 3 END AS BIGINT) AS \"limit\" FROM e) SELECT *, n_call > \"limit\" AS \"over\" FROM n",
    "stage_percent": f"SELECT event_id, CAST({_case('event_type', _PERCENT)} AS DOUBLE) AS percent FROM events",
    "event_lines": "SELECT user_id AS task_id, event_id AS seq, event_type AS event, CAST(user_id AS VARCHAR) AS data FROM events WHERE event_id % 6 > 1",
    "stream_progress": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT DISTINCT user_id, event_type AS md5 FROM events",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_bounded": "WITH e AS (SELECT user_id AS task_id, event_id AS seq, event_type AS event, event_type = 'purchase' AS reads FROM events), t AS (SELECT *, coalesce(sum(CAST(reads AS INTEGER)) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e), "
    "k AS (SELECT task_id, seq, event, row_number() OVER w AS place, greatest(0, count(*) OVER (PARTITION BY task_id, turn) - 4) AS dropped, turn FROM t WHERE NOT reads WINDOW w AS (PARTITION BY task_id, turn ORDER BY seq)), "
    "r AS (SELECT task_id, turn, seq AS taken FROM t WHERE reads) SELECT task_id, seq, event, taken, dropped FROM k JOIN r USING (task_id, turn) WHERE place <= 4",
    "stream_timeouts": "WITH g AS (SELECT user_id AS task_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), "
    "r AS (SELECT task_id, k, min(ts) AS started, max(ts) + INTERVAL 600 SECOND AS ended, count(*) AS n, k = max(k) OVER (PARTITION BY task_id) AS latest FROM s GROUP BY task_id, k) "
    "SELECT task_id, started, ended, n FROM r WHERE NOT latest OR epoch_ms(ended) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)",
}
