"""What Python workers keep between tasks."""

import os
import subprocess
import sys

from corpusmill.llm import common, near_join

KEPT = """
import re
import pyarrow as pa
from corpusmill.llm import common, {module}

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024

def run(batches):
    for batch in batches:
        parts = [bytes(60_000) for _ in range(4_000)]
        keep.append(bytes(60_000))  # lies above the others, so that they can't be given back from the end
        del parts
        yield batch

keep = []
before = held()
list({run}(iter([pa.RecordBatch.from_pydict({{"x": [1]}})])))
print(held() - before)
"""


def test_what_a_task_has_freed_goes_back():
    """240 MB in small pieces are freed below one that stays; an idle worker doesn't keep them."""
    code = KEPT.format(module="toxicity", run="common.tidy(run)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(out.stdout) < 20


def test_crowded_shingles_take_one_worker_a_task(spark, monkeypatch):
    """Two Python functions in one stage are two workers for each task, which stay for all that follows."""
    plans, real = [], near_join._bits

    def seen(numbers, bits):
        plans.append((bits, numbers._jdf.queryExecution().executedPlan().toString()))
        return real(numbers, bits)

    monkeypatch.setattr(near_join, "_bits", seen)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, f"{text} {k % 3}") for k in range(40)], "doc_id long, text string")
    got = near_join.near_groups(docs, words=4, percent=85).collect()
    assert {r["component_id"] for r in got} == {0, 1, 2}
    known = [plan for bits, plan in plans if bits == near_join.KNOWN_BITS]
    assert known and all(plan.split("Initial Plan")[0].count("MapInArrow") == 1 for plan in known)
    common.release(spark)
