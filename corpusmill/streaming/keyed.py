"""Keyed state of tasks: a bounded queue of progress events, and tasks that time out.

Both take a stream or a batch. On a stream the state of a task lies in Spark's
state store, so a query that is started again from its checkpoint goes on
where it was; on a batch the same rows come out of window functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DEFAULT, Params

_TAKEN = "task_id long, seq long, event string, taken long, dropped long"
_RUN = "task_id long, started long, ended long, n long, why string"


def bounded(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """events: (task_id, seq, event, reads). task_id, seq, event, taken, dropped: what readers of each task's queue get.

    A row puts its event, or, where reads is true, takes all that the queue
    holds. A queue of queue_size events is full: what comes then is dropped and
    counted. taken is the seq of the reading row, dropped what its queue had
    dropped since the one before. A read of an empty queue has no rows; what
    nobody has read is in the queue still and not in the result. Within a
    micro-batch rows count by seq, otherwise as they arrive; a null reads is
    false.
    """
    rows = events.select(F.col("task_id").cast("long"), F.col("seq").cast("long"), "event", F.coalesce("reads", F.lit(False)).alias("reads"))
    if not events.isStreaming:
        # the reads before a row, the row itself not, tell which queue it is in
        by = Window.partitionBy("task_id")
        turn = F.coalesce(F.sum(F.col("reads").cast("long")).over(by.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        queue = Window.partitionBy("task_id", "turn")
        told = rows.withColumn("turn", turn).withColumn("taken", F.max(F.when(F.col("reads"), F.col("seq"))).over(queue))
        told = told.where("taken is not null and not reads").withColumn("place", F.row_number().over(queue.orderBy("seq")))
        told = told.withColumn("dropped", F.greatest(F.lit(0), F.count(F.lit(1)).over(queue) - p.queue_size))
        return told.where(F.col("place") <= p.queue_size).select("task_id", "seq", "event", "taken", "dropped")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ("[]", 0)
        queue, out = json.loads(held), []
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if row.reads:
                out += [(key[0], seq, event, row.seq, dropped) for seq, event in queue]
                queue, dropped = [], 0
            elif len(queue) < p.queue_size:
                queue.append((int(row.seq), row.event))
            else:
                dropped += 1
        state.update((json.dumps(queue), dropped))
        yield pd.DataFrame(out, columns=["task_id", "seq", "event", "taken", "dropped"]).astype({"task_id": "int64", "seq": "int64", "event": object, "taken": "int64", "dropped": "int64"})

    return rows.groupBy("task_id").applyInPandasWithState(run, _TAKEN, "queue string, dropped long", "append", GroupStateTimeout.NoTimeout)


def timed_out(events: DataFrame, p: Params = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """events: (task_id, ts). task_id, started, ended, n, why: each run of a task's events that ended, as idle_seconds went by without one.

    ended is when the wait was over. A run ends by its timer, as the watermark
    passes that moment (why: timer), or as a later event of the task comes
    first (why: event); then its state goes, which releases the task for
    another run. Runs that neither has ended yet have no row. Events behind
    the watermark are dropped by Spark; others out of order count where their
    time puts them only within a micro-batch, otherwise they lengthen the run
    that is open. On a batch the watermark is that of the whole table.
    """
    idle = p.idle_seconds
    rows = events.select(F.col("task_id").cast("long"), F.col("ts").cast("timestamp")).where("task_id is not null and ts is not null")
    if not events.isStreaming:
        by = Window.partitionBy("task_id").orderBy("ts")
        seconds = F.unix_micros("ts")
        fresh = F.coalesce(seconds - F.lag(seconds).over(by) >= idle * 1_000_000, F.lit(True))
        runs = rows.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy("task_id", "run").agg(F.min("ts").alias("started"), (F.max("ts") + F.make_interval(secs=F.lit(idle))).alias("ended"), F.count(F.lit(1)).alias("n"))
        last = F.max("run").over(Window.partitionBy("task_id")) == F.col("run")
        # one row: the watermark, in whole milliseconds
        mark = rows.agg((F.unix_millis(F.max("ts")) - F.expr(f"unix_millis(timestamp_millis(0) + interval {delay})")).alias("mark"))
        told = runs.withColumn("last", last).crossJoin(F.broadcast(mark)).where(~F.col("last") | (F.unix_millis("ended") < F.col("mark")))
        return told.select("task_id", "started", "ended", "n", F.when(F.col("last"), "timer").otherwise("event").alias("why"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        wait = idle * 1_000_000
        if state.hasTimedOut:
            first, last, n = state.get
            out.append((key[0], first, last + wait, n, "timer"))
            state.remove()
        else:
            first, last, n = state.get if state.exists else (None, None, 0)
            for micros in sorted(x for pdf in batches for x in pdf["micros"].tolist()):
                if n and micros - last >= wait:
                    out.append((key[0], first, last + wait, n, "event"))
                    n = 0
                first, last, n = (micros, micros, 1) if not n else (first, max(last, micros), n + 1)
            state.update((first, last, n))
            state.setTimeoutTimestamp(max((last + wait) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "started", "ended", "n", "why"]).astype({"task_id": "int64", "started": "int64", "ended": "int64", "n": "int64", "why": object})

    held = rows.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    told = held.groupBy("task_id").applyInPandasWithState(run, _RUN, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("task_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "n", "why")
