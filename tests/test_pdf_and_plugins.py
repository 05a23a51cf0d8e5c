"""A PDF made by hand, and the places where models come in."""

import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import plugins
from corpusmill.operators import layout
from corpusmill.params import Params
from corpusmill.sources import pdf


def made(pages: list[bytes], extra: bytes = b"") -> bytes:
    """A file with a font that maps codes to Unicode and an image on the last page."""
    cmap = b"1 beginbfchar\n<0041> <4F60>\nendbfchar\n1 beginbfrange\n<0042> <0043> <597D>\nendbfrange"
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj"]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    out.append(b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /Resources << /Font << /F1 4 0 R /F2 5 0 R >> >> >> endobj")
    out.append(b"4 0 obj << /Type /Font >> endobj\n5 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj")
    out.append(b"6 0 obj << >> stream\n" + cmap + b"\nendstream endobj")
    out.append(b"7 0 obj << /Subtype /Image /Width 100 /Height 40 /Filter /DCTDecode >> stream\nx\nendstream endobj")
    for k, body in enumerate(pages):
        data = zlib.compress(body)
        own = b"/Resources << /XObject << /Im0 7 0 R >> /Font << /F1 4 0 R >> >>" if k == len(pages) - 1 else b""
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R %s /Contents %d 0 R >> endobj" % (10 + 2 * k, own, 11 + 2 * k))
        out.append(b"%d 0 obj << /Filter /FlateDecode >> stream\n%s\nendstream endobj" % (11 + 2 * k, data))
    return b"\n".join([*out, extra])


PAGES = [rb"BT /F1 12 Tf (Hello \(x\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET", b"BT /F2 12 Tf <004100420043> Tj ET", b"q Q"]


def test_pages():
    p = pdf.Pdf(made(PAGES))
    found = list(p.pages())
    assert [p.text(x) for x in found] == ["Hello (x)\nworld", "你好奾", ""]
    assert p.images(found[2], 3) == [{"name": "p3_i0.jpg", "w": 100, "h": 40}]
    with pytest.raises(pdf.Encrypted):
        pdf.Pdf(made(PAGES, b"trailer << /Encrypt 9 0 R >>"))


def test_files(spark):
    files = spark.createDataFrame([("a", bytearray(made(PAGES))), ("b", bytearray(made(PAGES[:1] * 2))), ("c", bytearray(b"junk"))], "path string, content binary")
    pages = pdf.load_pages(files)
    assert sorted((r["path"], r["page"]) for r in pages.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 0)]
    assert {r["path"] for r in pdf.complete_files(pages).collect()} == {"b"}
    assert pdf.page_images(pages.where("path = 'a'")).first()["images"] == {3: ["p3_i0.jpg"]}
    typed = layout.file_types(pages.where("page > 0").select(F.col("path").alias("file_id"), (F.length("text") > 0).alias("has_text"), "images"))
    assert {r["file_id"]: r["pdf_type"] for r in typed.collect()} == {"a": "mixed", "b": "mixed"}


def test_pages_by_type_in_one_plan(spark):
    """Text, mixed and scanned pages, broken files, a second extractor, against plain strings."""
    from corpusmill.plans import documents

    mixed = made([rb"BT /F1 12 Tf (Intro) Tj ET", rb"BT /F1 12 Tf (Figure below) Tj ET"])
    files = spark.createDataFrame([("t", bytearray(made(PAGES))), ("m", bytearray(mixed)), ("c", bytearray(b"junk")), ("e", bytearray(made(PAGES, b"trailer << /Encrypt 9 0 R >>")))], "path string, content binary")
    told = lambda images: [f"seen {c.decode()}" for c in images]
    read = lambda images: [[(9.0, "below"), (1.0, "above"), (5.0, " ")] for _ in images]
    tables = spark.createDataFrame([("m", 2, [[["a", None], ["b", "c"]]])], documents.TABLES)
    rows = {(r["path"], r["page"]): (r["page_type"], r["text"]) for r in documents.page_texts(files, captioner=told, recognizer=read, tables=tables).collect()}
    assert rows["t", 1] == ("text_pdf", "Hello (x)\nworld") and rows["t", 3] == ("scan_pdf", "above\nbelow")
    assert rows["m", 1] == ("text_pdf", "Intro") and rows["m", 2] == ("text_mix_pdf", "Figure below\n\na | \nb | c\n\n\n\n[图表描述]: seen x")
    assert rows["c", 0] == (None, None) and rows["e", 0] == (None, None)
    plain = {(r["path"], r["page"]): r["text"] for r in documents.page_texts(files, other=lambda content: ["one", "two"]).collect()}
    assert plain["t", 3] == plugins.described([b"x"])[0] and plain["c", 2] == "two" and plain["e", 0] is None


def test_image_bytes(spark):
    import io
    import zipfile

    samples = bytes(range(12))
    body = b"<< /Subtype /Image /Width 2 /Height 2 /Filter /FlateDecode >> stream\n" + zlib.compress(samples) + b"\nendstream"
    data = made(PAGES).replace(b"7 0 obj << /Subtype /Image /Width 100 /Height 40 /Filter /DCTDecode >> stream\nx\nendstream endobj", b"7 0 obj " + body + b" endobj")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/media/a.jpeg", b"J")
    files = spark.createDataFrame([("a.pdf", bytearray(data)), ("b.docx", bytearray(docx.getvalue())), ("c.pdf", bytearray(b"%PDF broken"))], "path string, content binary")
    rows = {(r["path"], r["page"], r["name"]): bytes(r["content"]) for r in pdf.load_images(files).collect()}
    assert set(rows) == {("a.pdf", 3, "p3_i0.png"), ("b.docx", 0, "docx_i0.jpeg")} and rows["b.docx", 0, "docx_i0.jpeg"] == b"J"
    made_png = rows["a.pdf", 3, "p3_i0.png"]
    assert made_png[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(made_png.split(b"IDAT")[1][:-16]) == b"\x00" + samples[:6] + b"\x00" + samples[6:]


def test_captions_that_fail(spark):
    df = spark.createDataFrame([(k, bytearray(b"x" * k)) for k in range(3)], "id long, content binary")

    def never(images):
        raise OSError

    assert {r["caption"] for r in plugins.caption(df, never, Params(embed_waits=())).collect()} == {None}
    assert [r["caption"] is None for r in plugins.caption(df, plugins.described).orderBy("id").collect()] == [True, False, False]
    assert plugins.recognize(df, never, Params(embed_waits=())).where("size(lines) > 0").count() == 0


def test_rewriting_in_the_plan(spark):
    """Queries that ask are searched by the vector of what the rewriter makes of them, others by their own."""
    from corpusmill.plans import search

    chunks = spark.createDataFrame([("u", 1, "alpha beta"), ("u", 2, "gamma delta"), ("u", 3, "other thing")], "user_id string, chunk_id long, text string")
    vectors = plugins.embed(chunks).select("user_id", "chunk_id", "embedding")
    q = spark.createDataFrame([(1, "u", "what is it?", "h"), (2, "u", "gamma delta longer text", "h"), (3, "u", "gamma", "h"), (4, "u", "is that so?", None)], "query_id long, user_id string, text string, history string")
    rewriter = lambda text, past: F.when(past.isNotNull(), "alpha beta").otherwise(" x")
    got = search.hybrid_search(chunks, vectors, q, embedder=plugins.hashed_words, rewriter=rewriter, threshold=0.5).collect()
    found = {(r["query_id"], r["strategy"]): r["chunk_id"] for r in got}
    assert found == {(1, "hybrid_rewritten"): 1, (2, "hybrid"): 2, (3, "bm25_only"): 2}


def test_embedding_in_batches(spark, tmp_path):
    df = spark.createDataFrame([(k, "a b" if k % 2 else "c") for k in range(9)], "id long, text string")
    rows = plugins.embed(df, p=Params(batch_count=2, embed_pause=0)).collect()
    assert len(rows) == 9 and rows[0].asDict().keys() == {"id", "text", "embedding"}
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in rows)
    log = str(tmp_path / "calls")

    def flaky(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        if sum(1 for _ in open(log)) == 1:
            raise OSError
        return [[0.0]] * len(texts)

    assert plugins.embed(df.coalesce(1), flaky, Params(batch_count=4, embed_pause=0, embed_waits=(0.0,))).count() == 9
    assert sorted(open(log).read().split()) == ["1", "4", "4", "4"]


def test_captions(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "file_id long, caption string")
    assert plugins.caption_summary(df).first()[1:] == (2, 1, 1)
