"""Catalogue, ledger, conversations, messages, tasks: pure functions that return the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..params import DEFAULT, Params

MESSAGE = "type string, content string"


# -- catalogue and ledger ------------------------------------------------------


def catalogue(chunks: DataFrame) -> DataFrame:
    """chunks: (user_id, md5, chunk_index, original_filename, created_at). One row a document, with the name and time of its first chunk."""
    first = F.min_by(F.struct("original_filename", "created_at"), "chunk_index")
    return chunks.groupBy("user_id", "md5").agg(first.alias("f"), F.count(F.lit(1)).alias("n_chunks")).select("user_id", "md5", "f.original_filename", F.col("f.created_at").alias("upload_time"), "n_chunks")


def reconcile(store: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a ledger needs to agree with the store: (user_id, md5, action) with backfill or purge."""
    add = store.select("user_id", "md5").distinct().join(ledger, ["user_id", "md5"], "left_anti").withColumn("action", F.lit("backfill"))
    drop = ledger.select("user_id", "md5").distinct().join(store, ["user_id", "md5"], "left_anti").withColumn("action", F.lit("purge"))
    return add.unionByName(drop)


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of both only, as often as they are."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Deletion: the rows whose keys are not among those that go."""
    return rows.join(gone.select(keys).distinct(), keys, "left_anti")


def cascade(chunks: DataFrame, ledger: DataFrame, images: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("user_id", "md5")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletion of documents, or with keys (user_id,) of tenants: what stays of chunks, ledger and images. Write them in this order: what a failure leaves behind is then still in the ledger, and can be deleted again."""
    return tuple(without(rows, gone, list(keys)) for rows in (chunks, ledger, images))  # type: ignore[return-value]


def orphan_images(images: DataFrame, ledger: DataFrame) -> DataFrame:
    """Images of documents that the ledger does not have, as after a failure."""
    return images.join(ledger.select("user_id", "md5").distinct(), ["user_id", "md5"], "left_anti")


def listed(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks of documents that the ledger has: what stays of a store when appending to the ledger has failed."""
    return chunks.join(ledger.select("user_id", "md5").distinct(), ["user_id", "md5"], "left_semi")


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with equal keys."""
    return without(rows, new, keys).unionByName(new, allowMissingColumns=True)


def by_filename(rows: DataFrame, name: str) -> DataFrame:
    """(user_id, md5) of the documents with a name."""
    return rows.where(F.col("original_filename") == name).select("user_id", "md5").distinct()


def migrate(old: DataFrame, new_columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are missing with their defaults; a blank time of the last message becomes that of creation."""
    out = old
    for name, default in new_columns.items():
        if name not in out.columns:
            out = out.withColumn(name, default)
    return out.withColumn("last_chat_time", F.coalesce(F.nullif("last_chat_time", F.lit("")), "created_at"))


# -- conversations -------------------------------------------------------------


def conversation_page(conversations: DataFrame, offset: int = 0, limit: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """A page of one tenant's list: pinned first, then newest, ties by id."""
    return conversations.orderBy(F.desc("is_top"), F.desc("last_chat_time"), "session_id").offset(offset).limit(limit or p.page_size)


def conversation_pages(conversations: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The page and place of every conversation in its tenant's list."""
    w = Window.partitionBy("user_id").orderBy(F.desc("is_top"), F.desc("last_chat_time"), "session_id")
    n = F.row_number().over(w) - 1
    return conversations.withColumn("place", n.cast("long")).withColumn("page", F.floor(F.col("place") / p.page_size))


def context_window(messages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """messages: (session_id, id, type, content). The last turns of each session; types other than human and ai go after the cut."""
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    last = messages.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * p.history_turns)
    return last.where(F.col("type").isin("human", "ai")).drop("n")


def session_history(messages: DataFrame, p: Params = DEFAULT, strip_marks: bool = True) -> DataFrame:
    """session_id, history: the context window as text."""
    kept = context_window(messages, p).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "type", "content"))).alias("m"))
    return kept.select("session_id", tx.history(F.col("m"), strip_marks).alias("history"))


def backfill_titles(conversations: DataFrame, messages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Blank titles become that of the session's first message."""
    first = messages.groupBy("session_id").agg(F.min_by("content", "id").alias("first"))
    blank = F.coalesce("session_title", F.lit("")) == ""
    return conversations.join(first, "session_id", "left").withColumn("session_title", F.when(blank, tx.title(F.col("first"), p)).otherwise(F.col("session_title"))).drop("first")


def append_exchange(conversations: DataFrame, messages: DataFrame, new: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """new: (session_id, human, ai, now). Two messages a row; times go on, and a blank title becomes that of the question."""
    last = messages.groupBy("session_id").agg(F.max("id").alias("last"))
    rows = new.join(last, "session_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    both = F.explode(F.array(F.struct((F.col("last") + 1).alias("id"), F.lit("human").alias("type"), F.col("human").alias("content")), F.struct((F.col("last") + 2).alias("id"), F.lit("ai").alias("type"), F.col("ai").alias("content"))))
    added = rows.select("session_id", both.alias("m")).select("session_id", "m.*")
    touched = conversations.join(new.select("session_id", "human", "now"), "session_id", "left")
    touched = touched.withColumn("last_chat_time", F.coalesce("now", "last_chat_time")).withColumn("session_title", F.when((F.coalesce("session_title", F.lit("")) == "") & F.col("human").isNotNull(), tx.title(F.col("human"), p)).otherwise(F.col("session_title")))
    return touched.drop("human", "now"), messages.unionByName(added.select(messages.columns))


def toggle_pin(conversations: DataFrame, session_id: object, is_top: int) -> DataFrame:
    return conversations.withColumn("is_top", F.when(F.col("session_id") == session_id, F.lit(is_top)).otherwise(F.col("is_top")))


def rename(conversations: DataFrame, session_id: object, name: str, p: Params = DEFAULT) -> DataFrame:
    return conversations.withColumn("session_title", F.when(F.col("session_id") == session_id, tx.title(F.lit(name), p)).otherwise(F.col("session_title")))


def decode_messages(stored: DataFrame) -> DataFrame:
    """stored: (session_id, id, message). What is no JSON keeps its text under the type unknown."""
    m = F.from_json("message", MESSAGE)
    ok = F.coalesce(m["type"].isNotNull(), F.lit(False))
    return stored.select("session_id", "id", F.when(ok, m["type"]).otherwise("unknown").alias("type"), F.when(ok, m["content"]).otherwise(F.col("message")).alias("content"))


def encode_message(kind: Column, content: Column) -> Column:
    return F.to_json(F.struct(kind.alias("type"), content.alias("content")))


# -- tasks and events ----------------------------------------------------------


def outcome(status: Column) -> Column:
    """success, skipped or failed."""
    return F.when(status.isin("done", "ok", "degraded"), "success").when(status.isin("duplicate", "unsupported_format"), "skipped").otherwise("failed")


def task_progress(results: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """results: (task_id, status). Tallies of each task; pending: what totals (task_id, total) has beyond."""
    o = outcome(F.col("status"))
    tally = results.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_results"), *[F.count_if(o == k).alias(k) for k in ("success", "skipped", "failed")],
        F.count_if(F.col("status") == "degraded").alias("degraded_files"), F.coalesce(F.bool_or(o == "success"), F.lit(False)).alias("any_success"),
    )
    if totals is None:
        return tally.withColumn("total", F.col("n_results")).withColumn("pending", F.lit(0).cast("long")).drop("n_results")
    both = totals.join(tally, "task_id", "left").na.fill(0, ["n_results", "success", "skipped", "failed", "degraded_files"]).na.fill(False, ["any_success"])
    return both.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("n_results"))).drop("n_results")


def error_details(results: DataFrame) -> DataFrame:
    """results: (task_id, seq, status). task_id, details (seq, status) in order: what of a task did not succeed."""
    bad = results.where(outcome(F.col("status")) != "success")
    return bad.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("seq", "status"))).alias("details"))


def tool_calls(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """events: (session_id, seq, tool). Adds the number of the call, the limit of the tool, and whether it is over."""
    limits = F.create_map(*[F.lit(x) for pair in p.tool_limits for x in pair])
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id", "tool").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    limit = F.coalesce(F.try_element_at(limits, F.col("tool")), F.lit(p.tool_limit_default))
    return events.withColumn("n_call", n).withColumn("limit", limit.cast("long")).withColumn("over", F.col("n_call") > F.col("limit"))


# How far an upload is at each stage.
STAGES = (("hashing", 0.02), ("checking", 0.05), ("extracting", 0.08), ("classifying", 0.12), ("loading", 0.15), ("cleaning", 0.45), ("splitting", 0.55), ("embedding", 0.70))


def stage_percent(stage: Column) -> Column:
    """Share of an upload that is done at a stage; unknown stages count as 0.3."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STAGES for x in pair]), stage), F.lit(0.3))


def event_lines(lines: DataFrame, schema: str = "event string, data string, stage string") -> DataFrame:
    """lines: (task_id, seq, line). Rows of the lines that carry data; what is no JSON goes."""
    data = F.from_json(F.substring("line", 7, 1 << 24), schema)
    return lines.where(F.col("line").startswith("data: ")).select("task_id", "seq", data.alias("d")).where(F.coalesce(F.col("d.event"), F.col("d.data"), F.col("d.stage")).isNotNull()).select("task_id", "seq", "d.*")


def last_lines(lines: Column, n: int = 10) -> Column:
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)


def chat_role(kind: Column) -> Column:
    return F.when(kind == "human", "user").otherwise("assistant")


def create_conversations(new: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """new: (session_id, user_id, first_query, now). Rows of conversations that begin."""
    return new.select("session_id", "user_id", tx.title(F.coalesce("first_query", F.lit("")), p).alias("session_title"), F.lit(0).alias("is_top"), F.col("now").alias("last_chat_time"), F.col("now").alias("created_at"))


def touch(conversations: DataFrame, seen: DataFrame) -> DataFrame:
    """seen: (session_id, now). Times of the last message go on."""
    return conversations.join(seen, "session_id", "left").withColumn("last_chat_time", F.coalesce("now", "last_chat_time")).drop("now")


def cancel_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that are under way become cancelled."""
    return tasks.withColumn("status", F.when(F.col("status").isin("completed", "failed"), F.col("status")).otherwise("cancelled"))


def merge_pages(shown: DataFrame, more: DataFrame) -> DataFrame:
    """A list that goes on with the next page, each conversation once."""
    return shown.unionByName(more).dropDuplicates(["session_id"])
