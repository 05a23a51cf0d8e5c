"""Shared helpers."""

import os

from corpusmill.llm import common


def test_intermediate_tables_are_released(spark):
    df = common.stored(spark.range(3), "numbers")
    path = common._made[-1].removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(path)
    common.release(spark)
    assert not os.path.exists(path)


def test_tables_keep_their_rows(spark):
    df = common.table(spark, "/root/testdata/sf0.001", "documents")
    assert df.count() == 200 and df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_long_operators_collect_the_drivers_garbage(spark, monkeypatch):
    from corpusmill.llm import common

    seen = []
    monkeypatch.setattr(common, "collect_garbage", seen.append)
    for _ in range(2 * common.COLLECT_EVERY):
        common.stored(spark.range(3), "few")
    assert len(seen) == 2
