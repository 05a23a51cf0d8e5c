"""Operators on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as text_functions
from corpusmill.operators import chunking, fusion, keyword, layout, uploads, vector
from corpusmill.operators import management as mg
from corpusmill.params import Params


def test_bm25(spark):
    chunks = spark.createDataFrame([("u", 1, "a b b"), ("u", 2, "a c"), ("u", 3, "d"), ("w", 4, "b")], "user_id string, chunk_id long, text string")
    q = spark.createDataFrame([(1, "u", "b"), (2, "u", "a"), (3, "u", "a c"), (4, "nobody", "a")], "query_id long, user_id string, text string")
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in keyword.keyword_topk(chunks, q).collect()}
    assert got == {(1, 1): 0.628708, (2, 1): 0.052125, (2, 2): 0.063853, (3, 1): 0.052125, (3, 2): 0.574679}
    full = keyword.keyword_topk(chunks, q, fill=True).where("query_id = 1").orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in full] == [(1, 0.628708), (2, 0.0), (3, 0.0)]


def test_vector_threshold(spark):
    v = spark.createDataFrame([("u", i, [math.cos(a), math.sin(a)]) for i, a in enumerate((0.0, 0.5, 1.0, 2.0))], "user_id string, chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(9, "u", [1.0, 0.0])], "query_id long, user_id string, embedding array<float>")
    ids = lambda **k: [r["chunk_id"] for r in vector.vector_topk(v, q, **k).orderBy("rank").collect()]
    assert ids(threshold=0) == [0, 1, 2, 3]
    assert ids(threshold=0.46) == [0, 1, 2]
    assert ids(p=Params(vector_k=2), threshold=0.0) == [0, 1]


def test_vector_groups(spark, monkeypatch):
    """Many queries in groups find what few find by broadcast, ties cut by chunk."""
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(f"u{k % 3}", k, rng.normal(size=4).tolist() if k % 5 else [1.0, 0.0, 0.0, 0.0]) for k in range(400)], "user_id string, chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(k, f"u{k % 4}", rng.normal(size=4).tolist()) for k in range(60)], "query_id long, user_id string, embedding array<double>")
    found = lambda: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 8)) for r in vector.vector_topk(v, q, threshold=0).collect())
    want = found()
    assert len(want) == 450
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector, "CHUNK_BLOCK", 50)
    assert found() == want


def test_fill(spark):
    """Against all chunks of the tenant, in the order of score and id."""
    chunks = spark.createDataFrame([("u", k, f"w{k % 7} x") for k in range(40)] + [("v", 100, "w1")], "user_id string, chunk_id long, text string")
    q = spark.createDataFrame([(k, "u", f"w{k} w{k + 1}") for k in range(5)] + [(9, "v", "none")], "query_id long, user_id string, text string")
    score = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in keyword.keyword_topk(chunks, q, Params(keyword_k=1000)).collect()}
    got = {}
    for r in keyword.keyword_topk(chunks, q, fill=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for k in range(5):
        assert got[k] == sorted(range(40), key=lambda c: (-score.get((k, c), 0.0), c))[:10]
    assert got[9] == [100]


def test_rrf(spark):
    k = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    v = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "query_id long, chunk_id string, rank int")
    got = [(r["chunk_id"], round(r["rrf_score"], 9)) for r in fusion.rrf(k, v).orderBy("position").collect()]
    assert got == [("x", 0.032522475), ("y", 0.032522475), ("z", 0.015873016)]


@pytest.mark.parametrize("text, want", [("spark", "bm25_only"), ("abcde fghij", "bm25_only"), ("abcdefghijk", "hybrid"), ("why?", "hybrid_rewritten"), ("怎么部署", "hybrid_rewritten"), ("", "bm25_only")])
def test_strategy(spark, text, want):
    assert spark.range(1).select(fusion.strategy(F.lit(text))).first()[0] == want


def test_rerank(spark):
    hits = spark.createDataFrame([(1, i, i, "a b", t) for i, t in enumerate(["x", "a b", "a", "b", "c", "a b", "q"])], "query_id long, chunk_id long, position long, query string, text string")
    assert [r["chunk_id"] for r in fusion.rerank(hits).orderBy("final_rank").collect()] == [1, 5, 2, 3, 0]
    assert [r["chunk_id"] for r in fusion.rerank(hits, scorer=None).orderBy("final_rank").collect()] == [0, 1, 2, 3, 4]


def test_split_text():
    assert chunking.split_text("  hello ") == ["hello"]
    assert chunking.split_text("") == []
    parts = chunking.split_text("x" * 1200)
    assert all(len(p) <= 500 for p in parts) and sum(map(len, parts)) >= 1200 and len(parts) == 3
    words = " ".join(f"w{i}" for i in range(900))
    parts = chunking.split_text(words)
    assert all(0 < len(p) <= 500 for p in parts)
    assert set(" ".join(parts).split()) == set(words.split())
    shared = [a.split()[-1] in b.split() for a, b in zip(parts[:-1], parts[1:], strict=True)]
    assert all(shared)


def plain_split(text, separators, size=500, overlap=50):
    """A splitter by the book: split at the first separator that occurs, keep it in front, merge small parts, go on with large ones."""
    sep, rest = "", ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep:
        parts = text.split(sep)
        parts = [parts[0]] + [sep + p for p in parts[1:]]
    else:
        parts = list(text)
    out, window = [], []

    def flush():
        nonlocal window
        if window:
            joined = "".join(window).strip()
            if joined:
                out.append(joined)

    def add(part):
        nonlocal window
        if window and sum(map(len, window)) + len(part) > size:
            flush()
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                window = window[1:]
        window.append(part)

    for part in (p for p in parts if p):
        if len(part) < size:
            add(part)
            continue
        flush()
        window = []
        if rest:
            out.extend(plain_split(part, rest, size, overlap))
        else:
            out.append(part)
    flush()
    return out


def test_split_chunks_on_the_table(spark):
    """All chunks of all texts, and what ingestion makes of them, against the plain splitter."""
    import hashlib
    from collections import Counter, defaultdict

    import pandas as pd
    from conftest import TESTDATA

    from corpusmill.params import SEPARATORS
    from corpusmill.plans import catalog

    d = pd.read_parquet(f"{TESTDATA}/documents.parquet")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = Counter()
    for i, t, source in zip(d.doc_id, d.text, d.source, strict=True):
        for k, piece in enumerate(plain_split(t, SEPARATORS)):
            want[f"{source}_{md5(f'{i}|{t}')}_{k:04d}", k, md5(piece), len(piece)] += 1
    got = Counter((r["chunk_id"], r["chunk_index"], r["md5"], r["n"]) for r in catalog.QUERIES["split_chunks"](spark, TESTDATA).collect())
    assert got == want
    clean = {r["t"]: r["c"] for r in spark.createDataFrame(d[["text"]]).select(F.col("text").alias("t"), text_functions.clean(F.col("text")).alias("c")).collect()}
    files = {(s, md5(t)): clean[t] for s, t in zip(d.source, d.text, strict=True) if clean[t]}
    told = defaultdict(lambda: [0, 0, 0])
    for (s, _), t in files.items():
        pieces = plain_split(t, SEPARATORS)
        told[s] = [told[s][0] + len(pieces), told[s][1] + (len(pieces) > 0), max([told[s][2], *map(len, pieces)])]
    assert {r["user_id"]: [r["n_chunks"], r["n_files"], r["longest"]] for r in catalog.QUERIES["ingest_files"](spark, TESTDATA).collect()} == told


def test_merge(spark):
    rows = [(1, 0, "a", 1, ["p"], [1.0, 0.0]), (1, 1, "b", 2, ["p", "q"], [1.0, 0.0]), (1, 2, "c", 5, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "file_id long, seq int, text string, page int, image_paths array<string>, embedding array<double>")
    got = [(r["text"], r["page_range"], r["image_paths"]) for r in chunking.merge_chunks(df).orderBy("seq").collect()]
    assert got == [("ab", "1-2", ["p", "q"]), ("c", "5", [])]
    assert chunking.merge_chunks(df, Params(merge_max_len=1)).count() == 3


def test_phash(spark):
    rows = [(1, 0, 0), (1, 1, None), (1, 2, 1023), (1, 3, 2047), (1, 4, -1), (2, 0, 1), (2, 1, None), (2, 2, 2**58 - 1), (2, 3, 2**58)]
    df = spark.createDataFrame(rows, "file_id long, seq int, hash long")
    got = {(r["file_id"], r["seq"]): r["rep_seq"] for r in chunking.phash_groups(df).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 3, (1, 4): 4, (2, 0): 0, (2, 1): 1, (2, 2): 2, (2, 3): 0}


def plain_batches(rows, p):
    out = {}
    for user in {r[0] for r in rows}:
        batch = n = c = 0
        for _, seq, x, y in sorted(r for r in rows if r[0] == user):
            out[user, seq] = batch
            n, c = n + (x or 0), c + (y or 0)
            if n >= p.batch_count or c >= p.batch_chars:
                batch, n, c = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("items", [1, 7, 64, 10_000])
def test_batches_over_ranges_are_those_of_one_loop(spark, items):
    import random

    from corpusmill.params import Params

    draw, p = random.Random(items), Params(batch_count=9, batch_chars=40)
    rows = [("big", k, draw.choice([0, 0, 1, 2, 3, 30]), draw.choice([0, 1, 5, 50])) for k in range(300)] + [("zero", k, 0, 0) for k in range(40)] + [("null", 3, None, None), ("null", 4, 9, None), ("null", 5, 1, 1)]
    df = spark.createDataFrame(rows, "user_id string, seq long, n_chunks long, n_chars long").repartition(5)
    assert {(r["user_id"], r["seq"]): r["batch"] for r in chunking.assign_batches(df, p, range_items=items).collect()} == plain_batches(rows, p)


def test_a_range_tells_what_it_does_to_any_open_batch():
    import numpy as np

    from corpusmill.params import Params

    draw, p = np.random.default_rng(7), Params(batch_count=6, batch_chars=20)
    for _ in range(200):
        x, y = draw.integers(0, 4, 12), draw.integers(0, 9, 12)
        told = chunking.range_map(x, y, p)
        assert len(told) <= 13
        for n in range(6):
            for c in range(0, 20, 3):
                closed, a, b = 0, n, c
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    a, b = a + i, b + j
                    if a >= 6 or b >= 20:
                        closed, a, b = closed + 1, 0, 0
                assert chunking.through_range(told, n, c, p) == (closed, a, b)


def test_batches_of_a_null_tenant_and_of_no_items(spark):
    df = spark.createDataFrame([(None, 1, 60, 1), (None, 2, 1, 1), ("", 1, 1, 1)], "user_id string, seq long, n_chunks long, n_chars long")
    assert sorted((r["user_id"] is None, r["seq"], r["batch"]) for r in chunking.assign_batches(df).collect()) == [(False, 1, 0), (True, 1, 0), (True, 2, 1)]
    assert chunking.assign_batches(df.limit(0)).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([("u", 1, 30, 9000), ("u", 2, 25, 1000), ("u", 3, 1, 18000), ("u", 4, 5, 100)], "user_id string, seq long, n_chunks int, n_chars long")
    assert [r["batch"] for r in chunking.assign_batches(df).orderBy("seq").collect()] == [0, 0, 1, 2]
    items = F.array_sort(F.collect_list(F.struct("seq", "n_chunks", "n_chars")))
    folded = df.groupBy("user_id").agg(items.alias("i")).select(chunking.batch_numbers(F.col("i")).alias("b")).first()["b"]
    assert [r["batch"] for r in folded] == [0, 0, 1, 2]


def test_pages(spark):
    rows = [(1, True, []), (2, True, [(31, 31)]), (3, True, [(30, 500)]), (4, False, [(100, 100)]), (5, False, [])]
    df = spark.createDataFrame(rows, "file_id long, has_text boolean, images array<struct<w:int,h:int>>")
    got = [r[0] for r in df.orderBy("file_id").select(layout.page_type(F.col("has_text"), F.col("images"))).collect()]
    assert got == ["text_pdf", "text_mix_pdf", "text_pdf", "scan_pdf", "text_pdf"]
    kinds = layout.file_types(df.withColumn("file_id", F.lit(1))).first()
    assert (kinds["pdf_type"], kinds["text_pdf"], kinds["scan_pdf"]) == ("mixed", 3, 1)


def test_boxes(spark):
    boxes = [(0, 9, 20, 20), (0, 5, 100, 10), (0, 1, 100, 60), (0, 3, 51, 51)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<x:int,y:int,w:int,h:int>>")
    text, images = layout.page_blocks(F.col("b"))
    r = df.select(text.alias("t"), images.alias("i")).first()
    assert [b["y"] for b in r["t"]] == [3, 5] and [b["y"] for b in r["i"]] == [1]


def test_degradation(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2, "b": 1})], "file_id long, counts map<string,int>")
    assert layout.merge_degradation(df).first()["counts"] == {"a": 3, "b": 1}


def test_captions(spark):
    images = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "file_id long, seq int, path string")
    cache = spark.createDataFrame([("a", "cap")], "path string, caption string")
    groups = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2)], "file_id long, seq int, rep_seq int")
    assert [r["caption"] for r in layout.captioned(images, cache, groups).orderBy("seq").collect()] == ["cap", "cap", None]


def test_uploads(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(uploads.validate(F.lit("c.PDF"), F.lit(5))) == "ok"
    assert one(uploads.validate(F.lit("d.exe"), F.lit(5))) == "unsupported_format"
    assert one(uploads.validate(F.lit("d.txt"), F.lit(200 << 20))) == "size_exceeded"
    assert one(uploads.member_allowed(F.lit("c.PDF"), exact_case=True)) is False
    assert one(uploads.archive_allowed(F.lit("a.tar.gz"))) is True
    assert one(uploads.diagnose(F.lit("89504E470D0A"))) == "unsupported_format"
    assert one(uploads.diagnose(F.lit(""))) == "empty_file"
    assert one(uploads.loader_error(F.array(F.lit("x"), F.lit("文件已加密")))) == "文件已加密"
    assert one(uploads.loader_error(F.array().cast("array<string>"))) == ""


def test_ingest(spark):
    from corpusmill.plans import ingest

    files = spark.createDataFrame([("u1", 1, "a.txt", "hello"), ("u1", 2, "b.txt", "hello"), ("u2", 3, "a.txt", "hello"), ("u1", 4, "e.txt", "\x00"), ("u1", 5, "k.txt", "known")], "user_id string, file_id long, original_filename string, text string")
    ledger = files.where("file_id = 5").select("user_id", F.md5("text").alias("md5"))
    chunks, rows = ingest.ingest(files, ledger)
    assert sorted((r["user_id"], r["original_filename"], r["text"]) for r in chunks.collect()) == [("u1", "a.txt", "hello"), ("u2", "a.txt", "hello")]
    assert rows.count() == 2
    again = ingest.merge_into(chunks, chunks)
    assert again.count() == 2


def test_reconcile_and_changes(spark):
    store = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, md5 string")
    ledger = spark.createDataFrame([("u", "b"), ("u", "c")], "user_id string, md5 string")
    assert sorted((r["md5"], r["action"]) for r in mg.reconcile(store, ledger).collect()) == [("a", "backfill"), ("c", "purge")]
    assert mg.changed(store, ledger).count() == 2 and mg.changed(store, store).count() == 0


def test_messages(spark):
    stored = spark.createDataFrame([("s", 1, '{"type": "human", "content": "hi"}'), ("s", 2, "broken")], "session_id string, id long, message string")
    assert [(r["type"], r["content"]) for r in mg.decode_messages(stored).orderBy("id").collect()] == [("human", "hi"), ("unknown", "broken")]
    m = spark.createDataFrame([("s", i, "system" if i == 11 else "human", str(i)) for i in range(12)], "session_id string, id long, type string, content string")
    assert sorted(r["id"] for r in mg.context_window(m).collect()) == list(range(2, 11))


def test_conversations(spark):
    c = spark.createDataFrame([("a", "u", "", 0, "1", "0"), ("b", "u", "t", 1, "0", "0")], "session_id string, user_id string, session_title string, is_top int, last_chat_time string, created_at string")
    assert [r["session_id"] for r in mg.conversation_page(c).collect()] == ["b", "a"]
    assert mg.toggle_pin(c, "a", 1).where("is_top = 1").count() == 2
    assert mg.rename(c, "a", "x" * 30).where("session_id = 'a'").first()["session_title"] == "x" * 20 + "..."
    old = c.withColumn("last_chat_time", F.lit("")).drop("is_top")
    assert mg.migrate(old, {"is_top": F.lit(0)}).where("last_chat_time = '0' and is_top = 0").count() == 2


def test_progress(spark):
    r = spark.createDataFrame([(1, s) for s in ("done", "ok", "degraded", "duplicate", "unsupported_format", "x")], "task_id long, status string")
    t = spark.createDataFrame([(1, 7), (2, 3)], "task_id long, total long")
    a, b = mg.task_progress(r, t).orderBy("task_id").collect()
    assert (a["success"], a["skipped"], a["failed"], a["degraded_files"], a["pending"], a["any_success"]) == (3, 2, 1, 1, 1, True)
    assert (b["success"], b["pending"], b["any_success"]) == (0, 3, False)


def test_tools(spark):
    e = spark.createDataFrame([(1, i, "web_search") for i in range(3)] + [(1, 9, "other")], "session_id long, seq long, tool string")
    assert [r["over"] for r in mg.tool_calls(e).orderBy("seq").collect()] == [False, False, True, False]
