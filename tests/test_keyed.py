"""Keyed streams against plain Python: in batches of any cut, over a restart, and as a batch."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.params import Params
from corpusmill.streaming import keyed

P = Params(queue_size=3, idle_seconds=600)


def plain_queue(rows, size):
    queue, dropped, out = defaultdict(list), defaultdict(int), []
    for task, seq, event, reads in sorted(rows, key=lambda r: r[1]):
        if reads:
            out += [(task, s, e, seq, dropped[task]) for s, e in queue[task]]
            queue[task], dropped[task] = [], 0
        elif len(queue[task]) < size:
            queue[task].append((seq, event))
        else:
            dropped[task] += 1
    return sorted(out)


def drained(spark, stream, tmp_path):
    """Starts the stream once more from its checkpoint, and returns all rows that it has given."""
    at = str(tmp_path / "out")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/n={n}")
    stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r)[: len(stream.columns)] for r in spark.read.schema(stream.schema).parquet(f"{at}/n=*").collect())


@pytest.fixture
def few_states(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_full_queue_drops_and_a_restart_loses_nothing(spark, tmp_path, few_states):
    draw = random.Random(3)
    rows = [(draw.randrange(3), k, f"e{k}", draw.random() < 0.2) for k in range(120)]
    df = spark.createDataFrame(rows, "task_id long, seq long, event string, reads boolean")
    want = plain_queue(rows, 3)
    assert any(r[4] for r in want)
    assert sorted(tuple(r) for r in keyed.bounded(df, P).collect()) == want
    src = str(tmp_path / "in")
    for lo, hi in ((0, 50), (50, 71), (71, 120)):  # three arrivals, the query is started again for each
        df.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(src)
        stream = keyed.bounded(spark.readStream.schema(df.schema).parquet(src), P)
        got = drained(spark, stream, tmp_path)
        assert got == [r for r in want if r[3] < hi]


def test_tasks_time_out(spark, tmp_path, few_states):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    first = [(1, at(0)), (1, at(599)), (1, at(1200)), (2, at(100)), (3, at(5000))]
    later = [(2, at(9000)), (1, at(9001)), (1, at(200))]  # the last is behind the watermark, and dropped
    end = [(9, at(40_000))]
    schema = "task_id long, ts timestamp"
    src = str(tmp_path / "in")
    seen = []
    for part in (first, later, end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = keyed.timed_out(spark.readStream.schema(schema).parquet(src), P, "10 minutes").withColumn("started", F.unix_seconds("started") - int(start.timestamp())).withColumn("ended", F.unix_seconds("ended") - int(start.timestamp()))
        seen.append(drained(spark, stream, tmp_path))
    offset = seen[0][0][1]  # of the session's time zone
    got = [[(t, s - offset, e - offset, n, w) for t, s, e, n, w in rows] for rows in seen]
    assert got[0] == [(1, 0, 1199, 2, "event"), (1, 1200, 1800, 1, "timer"), (2, 100, 700, 1, "timer")]
    assert set(got[1]) - set(got[0]) == {(3, 5000, 5600, 1, "timer")}
    assert set(got[2]) - set(got[1]) == {(1, 9001, 9601, 1, "timer"), (2, 9000, 9600, 1, "timer")}
    batch = keyed.timed_out(spark.createDataFrame(first + later[:2] + end, schema), P, "10 minutes")
    assert sorted((r["task_id"], int((r["started"] - start).total_seconds()), r["n"]) for r in batch.collect()) == sorted((t, s, n) for t, s, _, n, _ in got[2])
