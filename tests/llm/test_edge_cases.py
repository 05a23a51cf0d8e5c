"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names: every operator and every stage."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import common, exact_dedup, langid, mixing, near_join, pii, quality, sentencepieces, sharding, toxicity, warc

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("kept", "u", "recipe", "row", "t", "words", "token", "node", "n", "m", "shard", "slot", "cell", "bucket", "run", "pass", "key", "score", "label", "spans", "_keep", "a.b")


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    long_text = " ".join(word() for _ in range(30_000))
    some = " ".join(word() for _ in range(60)) + "."
    return [
        (1, some, "en", "a", 5), (2, some, "en", "a", 5), (2, some, "en", "a", 5), (3, some + " tail", None, None, None), (4, None, "en", "b", 0), (5, "", "de", "b", 0), (6, " \n\t ", "de", "b", 3),
        (None, "no id here at all", "fr", "c", 4), (None, None, None, None, None), (7, long_text, "en", "a", 9), (8, long_text + " x", "en", "a", 9), (9, "word " * 50_000, "en", "a", 1),
        (10, "x" * 40_000, "fr", "c", 1), (11, "one", "fr", "c", 1), (12, "one", "fr", "c", 1), (13, "日本語 🙂 \x00 é", "ja", "c", 1), (14, "mail a.b@c.de +1 (555) 123-4567", "en", "c", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(_texts(), COLUMNS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(1))
    return common.cut(df)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (5, 1, None), (11, 1, 0), (11, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, nothing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    nothing.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_exact(docs, nothing):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    for group in by.values():
        assert sum(r["kept"] for r in group) == 1 and all(r["group_size"] == len(group) for r in group)
    assert {r["keep_id"] for r in rows if r["doc_id"] in (4, 5, 6)} == {6}  # the most code points stay
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


def test_string_ids(spark):
    rows = [("b", "x y", "s"), ("a", "xy", "s"), (None, "x  y", "s"), ("a", "z", None), ("c", "z", None), ("c", "z", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = Counter((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == Counter([("b", None, False), ("a", None, False), (None, None, True), ("a", "a", True), ("c", "a", False), ("c", "a", False)])
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(df).collect()) == Counter([(None, "x  y"), ("a", "z")])
    emitted = Counter(r["doc_id"] for r in mixing.mixture(df).collect())
    assert Counter(r["doc_id"] for r in mixing.mix(df).collect()) == emitted and set(emitted) == {"a", "b", "c", None}


def test_chunks_follow_the_content(spark):
    """In every script: behind an insertion chunks are the same again."""
    rng = random.Random(5)
    for low, high in ((97, 122), (0x430, 0x44F), (0x4E00, 0x9FFF), (48, 57)):
        text = "".join(chr(rng.randint(low, high)) for _ in range(20_000))
        df = spark.createDataFrame([(1, text), (2, "!" + text)], "doc_id long, text string")
        found = [{c["h"] for c in r["chunks"]} for r in exact_dedup._digests(df, "text", "doc_id").orderBy("doc_id").collect()]
        assert len(found[0]) > 5 and len(found[0] & found[1]) >= len(found[0]) - 2


def test_quality(docs, nothing):
    rows = {r["doc_id"]: r for r in quality.measures(docs).collect()}
    assert rows[4]["n_words"] == 0 and rows[4]["base_failed"] and not rows[4]["kept"]
    assert rows[9]["n_words"] == 50_000 == rows[9]["n_repeat_words"] and rows[9]["base_failed"]
    assert rows[7]["n_words"] == 30_000
    assert quality.measures(docs).count() == docs.count()
    cleaned = quality.clean_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert quality.measures(nothing).count() == 0


def test_lines_that_fail(spark):
    """Menus, notices and calls go; prose that mentions them stays, in every language of the corpus."""
    bad = ["Home | News | Sport | Shop", "Start » Seite » Hier » Da", "© 2020 Firma. Alle Rechte vorbehalten.", "Tous droits réservés.", "Política de privacidad.", "Click here to read.", "Hier klicken.", "Buy!! Now!! Cheap!! Best!!", "## $$ %% && x.", "a" * 90]
    good = ["He ate a cookie, and then he asked her if there was another one left in the big tin.", "One | two.", "A short heading", "Das Wort newsletter kommt in diesem langen Satz einmal vor, was aber nicht weiter schlimm ist.", "Oh no!! Really.", "Line with \u2028 a separator | and | one more."]
    rows = spark.createDataFrame([(x,) for x in bad + good], "line string").select("line", quality.line_fails(F.col("line")).alias("fails")).collect()
    assert {r["line"] for r in rows if r["fails"]} == set(bad)


def test_near(docs, nothing):
    rows = near_join.near_groups(docs, 4, 85).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [got[k]["component_id"] for k in (1, 2, 3, 7, 8, 11, 12)] == [1, 1, 1, 7, 7, 11, 11]
    assert got[4]["n_shingles"] == got[5]["n_shingles"] == got[6]["n_shingles"] == 0 and got[5]["component_id"] == 5
    assert got[9]["n_shingles"] == 1 and got[10]["n_shingles"] == 1
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = near_join.drop_near_copies(docs)
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert kept.columns == docs.columns and ids == [1, 4, 5, 6, 7, 9, 10, 11, 13, 14]
    assert kept.where("doc_id is null").count() == 2
    assert near_join.near_groups(nothing).count() == 0 and near_join.drop_near_copies(nothing).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mixture(docs)
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.select("text").distinct().count() == docs.select("text").distinct().count()
    assert mixing.mixture(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_sharding(docs, nothing, tmp_path, monkeypatch):
    rows = sharding.assign(docs).collect()
    n = len(rows)
    assert n == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["size"] for r in rows if r["doc_id"] in (4, 5)} == {1}
    assert sharding.assign(nothing).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*docs.columns, "slot_", "shard_"]
    rows = lambda df: Counter(map(repr, df.select([F.col(f"`{c}`") for c in docs.columns]).collect()))
    assert rows(back) == rows(docs)
    same = docs.sparkSession.createDataFrame([(k % 2 or None, "t", "en", "a") for k in range(50)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(sharding, "SPLIT", 3)
    found = Counter(r["shard"] for r in sharding.assign(same, 4).collect())
    assert found == {0: 13, 1: 13, 2: 12, 3: 12}


def test_langid(docs, nothing):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[4]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows)
    bare = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.identify(docs, bare).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_toxicity(docs, labels, nothing, spark):
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, index).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.drop_toxic(docs, index).columns == docs.columns
    none = toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(nothing, index).count() == 0 and toxicity.drop_toxic(nothing, index).count() == 0


def test_pieces(docs, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    rows = sentencepieces.encode_documents(docs, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["ids"] == lib.encode(texts[r["doc_id"]] or "", add_eos=True)
    assert len(rows) == docs.count() and sentencepieces.encode_documents(nothing).count() == 0


def test_pii(docs, nothing):
    model = pii.fit(docs)
    rows = pii.detect(docs, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and got[4]["spans"] == [] == got[5]["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in got[14]["base"]] == [("email", 5, 13), ("phone", 14, 31)]
    redacted = pii.redact(docs, model)
    assert redacted.columns == docs.columns
    count = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    want = count(docs)
    del want[(14, "mail a.b@c.de +1 (555) 123-4567")]
    want[(14, "mail [EMAIL] [PHONE]")] = 1
    assert count(redacted) == want
    same = docs.sparkSession.createDataFrame([(1, "x a@b.de"), (1, "y c@d.de e"), (None, "f@g.de"), (None, None)], "doc_id long, text string")
    assert count(pii.redact(same, model)) == Counter([(1, "x [EMAIL]"), (1, "y [EMAIL] e"), (None, "[EMAIL]"), (None, None)])
    assert pii.detect(nothing, model).count() == 0
    assert pii.detect(nothing, pii.fit(nothing)).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 50_000
    pages = [(1, "http://a b\n", "x"), (2, None, "x"), (2, "http://c", "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "u", "x"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kind", F.lit("k"))
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=1000)
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r for r in rows}
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (1, 2, 3, 4, 5, 6, None)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("revisit", 5), ("response", None)]
    assert got[6]["payload_bytes"] == len(big.encode()) and got[6]["payload_digest"] == warc.base32_sha1(big.encode())
    assert got[7]["payload_bytes"] == 14


def test_warc_identifiers(spark, tmp_path):
    """All identifiers differ, those referred to are there, and every file begins with a warcinfo record."""
    pages = [(k % 7, "u", f"{k % 3}" * 3000) for k in range(60)] + [(None, "u", "x")] * 2
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"), segment_bytes=900)
    found = []
    for f in (tmp_path / "w").glob("part-*"):
        held = [x for x, _ in warc.parse(warc.plain(f.read_bytes()))]
        assert not held or held[0]["warc-type"] == "warcinfo"
        found += held
    ids = [x["warc-record-id"] for x in found]
    assert len(ids) == len(set(ids)) and {x["warc-refers-to"] for x in found if "warc-refers-to" in x} <= set(ids)
    assert Counter(x["warc-type"] for x in found)["response"] + Counter(x["warc-type"] for x in found)["revisit"] == len(pages)


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding:chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\n\r\n"
    record = lambda head, block: (f"WARC/1.0\r\n{head}\r\nContent-Length:{len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    good = [
        record("WARC-Type:warcinfo\r\nWARC-Record-ID:<urn:uuid:0>", b"software: x\r\n"),
        record("WARC-Type:request\r\nWARC-Record-ID:<urn:uuid:1>", b"GET / HTTP/1.1\r\n\r\n"),
        record("WARC-Type:response\r\nWARC-Record-ID:<urn:uuid:2>\r\nContent-Type: application/http;\r\n msgtype=response\r\nWARC-Target-URI: http://a/", http),
        record("WARC-Type:resource\r\nWARC-Record-ID:<urn:uuid:3>\r\nContent-Type: text/plain", b"plain"),
        record("WARC-Type:response\r\nWARC-Record-ID:<urn:uuid:4>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:AAAA", http),
        record("WARC-Type:continuation\r\nWARC-Record-ID:<urn:uuid:5>\r\nWARC-Segment-Origin-ID:<urn:uuid:9>\r\nWARC-Segment-Number:2\r\nWARC-Segment-Total-Length: 9", b"late"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in good))
    (tmp_path / "b.warc").write_bytes(b"".join(good[:4])[:-30])
    (tmp_path / "c.warc").write_bytes(b"no archive")
    rows = [r.asDict() for r in warc.read_records(spark, str(tmp_path)).collect()]
    named = {r["record_id"]: r for r in rows if r["record_id"]}
    assert (named["<urn:uuid:2>"]["payload_bytes"], named["<urn:uuid:2>"]["digest"], named["<urn:uuid:2>"]["target"]) == (3, warc.base32_sha1(b"abc"), "http://a/")
    assert named["<urn:uuid:3>"]["payload_bytes"] == 5 and named["<urn:uuid:0>"]["error"] is None
    assert "digest" in named["<urn:uuid:4>"]["error"] and "segments" in named["<urn:uuid:5>"]["error"] and named["<urn:uuid:4>"]["payload_bytes"] is None
    assert sum((r["error"] or "").startswith("archive") for r in rows) == 2
    assert warc.read_archives(spark, str(tmp_path)).where("page_id is not null").count() == 0


def test_warc_segments_in_other_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    df = spark.createDataFrame([(k, "u", f"{k}" * 5000) for k in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=900)
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in rows) == [(k, 5000) for k in range(4)]


def test_stages(spark, docs, folder, empty_folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), empty_folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_empty_tables(spark, empty_folder):
    from corpusmill.llm import registry

    for name, query in registry.QUERIES.items():
        assert query(spark, empty_folder).count() == 0, name
    assert corpus_pipeline.run(spark, empty_folder).count() == 0
