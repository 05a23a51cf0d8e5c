"""Building a kept keyword index takes every text apart once."""

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import keyword


def test_texts_are_taken_apart_once(spark, tmp_path):
    rows = [("u", 1, "a b a"), ("u", 2, ""), ("u", 3, None), ("v", 4, "b c"), ("v", 5, "c c c")]
    chunks = spark.createDataFrame(rows, "user_id string, chunk_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        seen.add(1)
        return text.split() if text is not None else None

    keyword.build_index(chunks, str(tmp_path / "new"), tokenizer=lambda c: words(c))
    assert seen.value == len(rows)
    keyword.write_index(keyword.term_tables(chunks, tokenizer=tx.words), str(tmp_path / "old"))
    new, old = (keyword.read_index(spark, str(tmp_path / x)) for x in ("new", "old"))
    for a, b in zip(new, old, strict=True):
        assert sorted(map(str, (tuple(r) for r in a.select(*b.columns).collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))
