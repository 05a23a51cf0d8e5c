"""The versioned store against a plain model, its failures, and which files it opens."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import management
from corpusmill.plans import ingest
from corpusmill.sources import store as st
from corpusmill.sources.store import Store

SCHEMA = "user_id string, md5 string, chunk_id long, note string"


@pytest.fixture
def rows(spark):
    return lambda values: spark.createDataFrame(values, SCHEMA)


def held(store, table="chunks", version=None):
    return sorted(tuple(r) for r in store.read(table, store.state(version)).collect())


def test_random_histories_agree_with_a_model(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(st, "WHOLE_EVERY", 4)
    draw = random.Random(11)
    store = ingest.open_store(spark, str(tmp_path / "s"))
    model, past = [], {}
    new = lambda n: [(draw.choice("abc"), f"m{draw.randrange(9)}", draw.randrange(40), f"n{draw.randrange(99)}") for _ in range(n)]
    for turn in range(14):
        what = draw.choice(["append", "delete", "tenant", "upsert", "compact"]) if turn else "append"
        if what == "append":
            more = new(draw.randrange(1, 6))
            store.append({"chunks": rows(more)}, ("s", turn), ranged=draw.random() < 0.5)
            store.append({"chunks": rows(more)}, ("s", turn))  # a replay
            model = model + more
        elif what == "delete":
            gone = {(u, m) for u, m, _, _ in draw.sample(model, min(2, len(model)))} | {("a", "none")}
            store.delete({"chunks": spark.createDataFrame(sorted(gone), "user_id string, md5 string")})
            model = [r for r in model if r[:2] not in gone]
        elif what == "tenant":
            store.delete({"chunks": spark.createDataFrame([("b",)], "user_id string")})
            model = [r for r in model if r[0] != "b"]
        elif what == "upsert":
            more = list({r[2]: r for r in new(4)}.values())
            store.upsert("chunks", rows(more), ["chunk_id"])
            model = [r for r in model if r[2] not in {m[2] for m in more}] + more
        else:
            store.compact("chunks", every=draw.random() < 0.5)
        past[store.version()] = sorted(model)
        assert held(store) == sorted(model)
    for version, was in past.items():
        assert held(Store(spark, store.root, store.keys), version=version) == was
    assert store.vacuum(versions=1, older_s=0) > 0 and held(store) == sorted(model)


def uploaded(store, spark, user, *md5s, note="x", fail=False):
    chunks = spark.createDataFrame([(user, m, k, note) for m in md5s for k in range(2)], SCHEMA)
    ledger = spark.createDataFrame([(user, m) for m in md5s], "user_id string, md5 string")
    return ingest.record(store, chunks, ledger.withColumn("z", F.raise_error(F.lit("disk")).cast("string")) if fail else ledger)


def test_a_second_upload_keeps_the_first_and_a_failed_one_leaves_nothing(spark, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "s"))
    uploaded(store, spark, "u", "m1", note="first")
    before = held(store), held(store, "ledger")
    with pytest.raises(Exception, match="disk"):
        uploaded(store, spark, "u", "m2", fail=True)
    assert (held(store), held(store, "ledger")) == before
    uploaded(store, spark, "u", "m2", "m1", note="second")
    assert {(r[1], r[3]) for r in held(store)} == {("m1", "first"), ("m2", "second")}
    assert held(store, "ledger") == [("u", "m1"), ("u", "m2")]
    version = store.version()
    assert uploaded(store, spark, "u", "m2", "m1") == version and len(held(store)) == 4  # a replay


def test_a_job_killed_before_its_commit_leaves_the_old_version(spark, tmp_path, rows):
    store = ingest.open_store(spark, str(tmp_path / "s"))
    store.append({"chunks": rows([("a", "1", 1, "x")])})
    store.write("chunks", rows([("a", "2", 2, "y")]))  # written, never committed
    again = Store(spark, store.root, store.keys)
    assert held(again) == [("a", "1", 1, "x")]
    assert again.vacuum(older_s=3600) == 0 and again.vacuum(older_s=0) > 0 and held(again) == [("a", "1", 1, "x")]


def test_two_writers_lose_nothing(spark, tmp_path, rows):
    one = ingest.open_store(spark, str(tmp_path / "s"))
    uploaded(one, spark, "u", "m1")
    other = ingest.open_store(spark, str(tmp_path / "s"))
    raced = []
    publish = one._publish

    def late(state, change):
        if not raced:
            raced.append(uploaded(other, spark, "u", "m2", "m3"))
        return publish(state, change)

    one._publish = late
    uploaded(one, spark, "u", "m3", "m4")
    assert held(one, "ledger") == [("u", f"m{k}") for k in range(1, 5)] and len(held(one)) == 8


def test_deleting_a_document_opens_only_files_that_may_hold_it(spark, tmp_path, rows):
    store = ingest.open_store(spark, str(tmp_path / "s"))
    values = [(f"u{k % 5}", f"m{k:03d}", k, "x") for k in range(200)]
    store.append({"chunks": rows(values)}, ranged=True, parts=8)
    gone = spark.createDataFrame([("u2", "m042")], "user_id string, md5 string")
    state = store.state()
    may = store.holders(state, "chunks", gone)
    assert 0 < len(may) < len(state.of("chunks")) and len(state.of("chunks")) > 2
    for f in state.of("chunks"):
        if f not in may:
            os.rename(f"{store.root}/{f.path}", f"{tmp_path}/{f.name}")  # to open one of these would fail
    store.delete({"chunks": gone})
    for f in state.of("chunks"):
        if f not in may:
            os.rename(f"{tmp_path}/{f.name}", f"{store.root}/{f.path}")
    assert held(store) == sorted(tuple(r) for r in management.without(rows(values), gone, ["user_id", "md5"]).collect())
    marked = [f for f in store.state().of("chunks") if f.marks]
    assert [f.gone for f in marked] == [1]
    assert not store.read("chunks", files=[f for f in store.state().of("chunks") if not f.marks])._jdf.queryExecution().toString().count("LeftAnti")
    store.compact("chunks")
    assert not any(f.marks for f in store.state().of("chunks")) and len(held(store)) == 199


def test_many_keys_choose_files_by_their_range(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(st, "KEYS_HELD", 3)
    store = ingest.open_store(spark, str(tmp_path / "s"))
    store.append({"chunks": rows([("a", f"{k:02d}", k, "") for k in range(50)])}, ranged=True, parts=4)
    gone = spark.createDataFrame([(f"{k:02d}",) for k in range(12)] + [(None,)], "md5 string")
    assert len(store.holders(store.state(), "chunks", gone)) < len(store.state().of("chunks"))
    store.delete({"chunks": gone})
    assert [r[2] for r in held(store)] == list(range(12, 50))


def test_empty_tables_null_keys_and_new_columns(spark, tmp_path, rows):
    store = ingest.open_store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no table"):
        store.read("chunks")
    store.append({"chunks": rows([])})
    assert held(store) == [] and store.read("chunks").columns == [c.split()[0] for c in SCHEMA.split(", ")]
    store.append({"chunks": rows([("a", None, 1, "x"), (None, None, 2, "y")])})
    store.delete({"chunks": spark.createDataFrame([("a", None), ("a", "z")], "user_id string, md5 string")})
    store.append({"chunks": rows([("b", "1", 3, "z")]).withColumn("more", F.lit(7))})
    assert sorted((r["chunk_id"], r["more"]) for r in store.read("chunks").collect()) == [(1, None), (2, None), (3, 7)]
    with pytest.raises(ValueError, match="no version"):
        store.state(99)


def test_upload_runs_the_whole_plan(spark, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "s"))
    files = lambda *texts: spark.createDataFrame([("u", k, f"f{k}.txt", t) for k, t in enumerate(texts)], "user_id string, file_id long, original_filename string, text string")
    ingest.upload(store, files("one text", "another text"))
    ingest.upload(store, files("a third text", "one text", ""))
    assert sorted(r["text"] for r in store.read("chunks").collect()) == ["a third text", "another text", "one text"]
    gone = store.read("ledger").where("original_filename = 'f1.txt'").select("user_id", "md5")
    ingest.remove(store, gone)
    assert sorted(r["text"] for r in store.read("chunks").collect()) == ["a third text", "one text"] and len(held(store, "ledger")) == 2
