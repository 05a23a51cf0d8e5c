"""The segmented keyword index against the ranking from scratch, over histories of changes."""

import random

import pytest
from conftest import TESTDATA

from corpusmill.operators import keyword, segments
from corpusmill.operators.segments import KeywordIndex
from corpusmill.params import Params
from corpusmill.sources import tables

CHUNKS = "user_id string, chunk_id long, text string"


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


def text(draw):
    return " ".join(f"w{int(draw.paretovariate(0.5)) % 60}" for _ in range(draw.randrange(1, 30)))


def test_any_history_ranks_as_from_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "FIRST", 2)
    monkeypatch.setattr(segments, "FAN_IN", 3)
    draw = random.Random(5)
    queries = spark.createDataFrame([(k, draw.choice("ab"), text(draw)) for k in range(6)] + [(90, "a", "unknown"), (91, "z", "w1"), (92, "a", None), (93, None, "w1")], "query_id long, user_id string, text string")
    index, model, p = KeywordIndex(spark, str(tmp_path / "i"), Params(keyword_k=4)), {}, Params(keyword_k=4)
    assert index.search(queries).count() == 0
    for turn in range(7):
        what = draw.choice(["add", "add", "delete", "replace", "merge"]) if turn > 1 else "add"
        rows = [(draw.choice("ab"), 100 * turn + k, text(draw)) for k in range(draw.randrange(4, 14))] + [("a", 100 * turn + 50, ""), ("b", 100 * turn + 51, None)]
        gone = draw.sample(sorted(model), min(5, len(model) // 3))
        if what == "add":
            index.update(spark.createDataFrame(rows, CHUNKS))
            model |= {(u, c): t for u, c, t in rows}
        elif what == "delete":
            index.update(gone=spark.createDataFrame([*gone, ("a", 12345)], "user_id string, chunk_id long"))
            model = {k: t for k, t in model.items() if k not in gone}
        elif what == "replace":
            rows = [(u, c, text(draw)) for u, c in gone]
            index.update(spark.createDataFrame(rows, CHUNKS))
            model |= {(u, c): t for u, c, t in rows}
        else:
            index.merge(every=draw.random() < 0.5)
        chunks = spark.createDataFrame([(u, c, t) for (u, c), t in sorted(model.items())], CHUNKS)
        assert ranked(index.search(queries)) == ranked(keyword.keyword_topk(chunks, queries, p)), what
        assert sum(index.segments().values()) == len(model)
    index.merge(every=True)
    assert len(index.segments()) == 1 and not any(f.marks for f in index.store.state().of("tokens"))
    assert ranked(KeywordIndex(spark, str(tmp_path / "i"), p).search(queries)) == ranked(keyword.keyword_topk(chunks, queries, p))


def test_additions_and_merges_tokenise_nothing_again(spark, tmp_path):
    from pyspark.sql import functions as F

    broken = lambda c: F.when(c == "old text", F.raise_error(F.lit("tokenised again"))).otherwise(F.split(c, " ")).cast("array<string>")
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([("a", 1, "old text")], CHUNKS))
    index.tokenizer = broken
    index.update(spark.createDataFrame([("a", 2, "new text"), ("a", 3, "more words here")], CHUNKS), gone=spark.createDataFrame([("a", 1)], "user_id string, chunk_id long"))
    index.update(spark.createDataFrame([("a", 4, "text of a third segment")], CHUNKS))
    index.merge(every=True)
    assert ranked(index.search(spark.createDataFrame([(1, "a", "new")], "query_id long, user_id string, text string")))[0][2] == 2
    with pytest.raises(Exception, match="tokenised again"):
        index.update(spark.createDataFrame([("a", 5, "old text")], CHUNKS))
    assert sum(index.segments().values()) == 3


def test_merges_put_segments_of_like_size_together(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"))
    for turn in range(5):
        index.update(spark.createDataFrame([("a", 10 * turn + k, f"x{k} y{turn}") for k in range(2)], CHUNKS))
    index.update(spark.createDataFrame([("a", 1000 + k, f"x{k}") for k in range(200)], CHUNKS))
    index.merge()
    assert sorted(index.segments().values()) == [10, 200]


def test_blocks_are_skipped(spark, tmp_path):
    from pyspark.sql import functions as F

    whole, told = TESTDATA.replace("sf0.001", "sf0.01"), {}
    one = lambda df: df.withColumn("user_id", F.lit("a"))
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.update(one(tables.chunks(spark, whole)))
    found = index.search(one(tables.queries(spark, whole)), told)
    assert 0 < told["scored"] < 0.6 * told["blocks"]
    assert ranked(found) == ranked(keyword.keyword_topk(one(tables.chunks(spark, whole)), one(tables.queries(spark, whole))))


def test_tasks_of_a_segment_read_little_at_once(spark, tmp_path, monkeypatch):
    name = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(name), []
    index = KeywordIndex(spark, str(tmp_path / "i"))
    written = index.store.write
    monkeypatch.setattr(index.store, "write", lambda table, rows, *a, **k: (seen.append((table, spark.conf.get(name))), written(table, rows, *a, **k))[1])
    index.update(spark.createDataFrame([("u", 1, "a b")], CHUNKS))
    assert {t: size for t, size in seen if t in segments.OWN} == dict.fromkeys(segments.OWN, str(segments.SORT_BYTES))
    assert spark.conf.get(name) == before


def test_additions_that_replace_nothing_move_no_terms(spark, tmp_path, monkeypatch):
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([("u", 1, "a b"), ("u", 3, "c")], CHUNKS))
    kept, stored = [], index._stored
    monkeypatch.setattr(index, "_stored", lambda rows, name: (kept.append((name, rows.columns)), stored(rows, name))[1])
    index.update(spark.createDataFrame([("u", 2, "a")], CHUNKS))
    assert not any("terms" in columns for _, columns in kept)
    index.update(spark.createDataFrame([("u", 3, "d d")], CHUNKS))
    assert ranked(index.search(spark.createDataFrame([(1, "u", "c"), (2, "u", "d")], "query_id long, user_id string, text string")))[0][2] == 3
    assert any("terms" in columns for _, columns in kept)
