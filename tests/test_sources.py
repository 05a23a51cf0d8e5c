"""Files and streams, written to a temporary folder."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from corpusmill.sources import loaders
from corpusmill.streaming import events as ev


def test_decode():
    assert loaders.decode(b"hello") == "hello"
    assert loaders.decode(bytes.fromhex("C4E3BAC3")) == "你好"
    assert loaders.decode(b"\xff\xff\xff") == "ÿÿÿ"
    assert loaders.decode(b"  ") == ""


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    par = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{par('A', 'Heading1')}{par('text')}{par('B', 'Heading2')}</w:body></w:document>")
        z.writestr("word/media/x.png", b"1")
    return out.getvalue()


def _pptx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>s{k}</a:t></a:r></a:p><a:p/></p>')
    return out.getvalue()


def test_files_and_archives(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes("grün".encode())
    (folder / "b.md").write_text("# T\n\nx")
    (folder / "c.docx").write_bytes(_docx())
    (folder / "d.pptx").write_bytes(_pptx())
    (folder / "e.xyz").write_bytes(b"?")
    got = {r["ext"]: r for r in loaders.load_files(loaders.read_files(spark, str(folder))).collect()}
    assert got["txt"]["text"] == "grün"
    assert got["md"]["current_chapter"] == "T"
    assert [h["path"] for h in got["docx"]["toc"]] == ["A", "A > B"] and got["docx"]["image_paths"] == ["docx_i0.png"]
    assert got["pptx"]["text"] == "s2\ns10"
    assert got["xyz"]["text"] is None and got["xyz"]["error"]

    store = tmp_path / "archives"
    store.mkdir()
    with zipfile.ZipFile(store / "a.zip", "w") as z:
        z.writestr("d/x.txt", "1")
        z.writestr("../evil.txt", "2")
    with tarfile.open(store / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"3"))
    members = loaders.expand_archives(loaders.read_files(spark, str(store)))
    assert sorted((r["name"], bytes(r["content"])) for r in members.collect()) == [("d/x.txt", b"1"), ("y.txt", b"3")]


def test_archives_that_do_not_fit_or_are_broken(spark):
    import io
    import zipfile

    from corpusmill.params import Params

    def zipped(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members.items():
                z.writestr(name, data)
        return bytearray(out.getvalue())

    df = spark.createDataFrame([("a.zip", zipped(a=b"1" * 50, b=b"2" * 60)), ("b.zip", bytearray(b"PK junk")), ("c.tar.gz", bytearray(b"junk")), ("d.zip", zipped(x=b"3")), ("e.zip", zipped(**{f"n{k}": b"" for k in range(90)}))], "path string, content binary")
    rows = loaders.expand_archives(df, Params(max_expanded_bytes=100, max_archive_bytes=5000)).collect()
    told = {(r["archive"], r["name"]): (r["content"] and bytes(r["content"]), r["error"]) for r in rows}
    assert told["a.zip", "a"] == (b"1" * 50, None) and told["a.zip", None] == (None, "size_exceeded") and ("a.zip", "b") not in told
    assert "BadZipFile" in told["b.zip", None][1] and "ReadError" in told["c.tar.gz", None][1]
    assert told["d.zip", "x"] == (b"3", None) and told["e.zip", None] == (None, "size_exceeded")


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("u", "m1", "f", "f", "t"), ("u", "m2", "g", "g", "t")], "user_id string, md5 string, filename string, original_filename string, upload_time string")
    loaders.append_ledger(rows, path)
    with open(f"{path}/user_id=u/extra.json", "w") as f:
        f.write("\n{broken\n")
    assert sorted(r["md5"] for r in loaders.read_ledger(spark, path).collect()) == ["m1", "m2"]
    left = [r["value"] for r in loaders.delete_from_ledger(spark, path, "m1").collect()]
    assert any("m2" in x for x in left) and any("broken" in x for x in left) and not any('"m1"' in x for x in left)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("u", "a", 1), ("u", "a", 2), ("u", "b", 4000)], "user_id string, md5 string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(src)
    seen = []
    q = ev.ingest_stream(spark, src, rows.schema, str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    assert seen == [3]
    stream = spark.readStream.schema(rows.schema).parquet(src)
    assert ev.run_to_table(ev.first_uploads(stream), "first_uploads", "append").count() == 2
    assert ev.sessions(rows).count() == 2
    steps = spark.createDataFrame([(1, 1, "stage"), (1, 2, "done"), (1, 3, "token"), (2, 1, "stage")], "task_id long, seq long, event string")
    assert ev.until_done(steps).count() == 3
