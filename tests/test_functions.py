"""Hand-made rows with results worked out from the rules."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.markdown import parse_markdown
from corpusmill.params import Params


def value(spark, column, **cols):
    df = spark.range(1).select([v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\n\n\n\nb", "a\n\nb"),
        ("x    y", "x y"),
        ("a\n12\nb", "a\n\nb"),
        ("a\n12345\nb", "a\n12345\nb"),
        ("Intro.....12\nBody", "Body"),
        ("Kap (10)\nBody", "Body"),
        ("--- Page 3 ---\nend", "end"),
        ("\x00\x0b", None),
        (" \n \n \nA", "A"),
        ("a\n \n \n \nb", "a\n\n\n\nb"),
        ("目 录\n第 1 页 / 共 9 页\n正文", "正文"),
        ("　x \n１２\nz", "x\n\nz"),
        ("", None),
    ],
)
def test_clean(spark, text, want):
    assert value(spark, tx.clean(F.col("t")), t=text) == want


MARKED = ["**b** [t](u) ![a](u)", "# H\n> q\n- x\n1. y\n---", "*i* _j_ ~~s~~ `c` <b>z</b>", "a\n\n\n\nb", "__x__ * y * 2*3*4", "snake_case_name"]


@pytest.mark.parametrize("text", MARKED)
def test_markup_as_python_sees_it(spark, text):
    lines = []
    for line in text.split("\n"):
        for pattern, stays in tx.MARKUP:
            line = re.sub(pattern, stays.replace("$1", r"\1"), line)
        lines.append(line)
    want = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    assert value(spark, tx.strip_markup(F.col("t")), t=text) == want


@pytest.mark.parametrize("pages, want", [([1, 2, 3], "1-3"), ([1, 3, 5], "1,3,5"), ([5, 1, 2, 2], "1-2,5"), ([], ""), ([7], "7")])
def test_page_ranges(spark, pages, want):
    p = F.array(*[F.lit(x) for x in pages]).cast("array<int>")
    assert value(spark, tx.page_ranges(F.col("p")), p=p) == want


def test_titles_and_ids(spark):
    assert value(spark, tx.title(F.col("t")), t="x" * 20) == "x" * 20
    assert value(spark, tx.title(F.col("t")), t="x" * 21) == "x" * 20 + "..."
    assert value(spark, tx.chunk_id(F.lit("u1"), F.lit("abc"), F.lit(7))) == "u1_abc_0007"
    assert value(spark, tx.chunk_id(F.lit("u1"), F.lit("abc"), F.lit(12345))) == "u1_abc_12345"


def test_toc_paths(spark):
    heads = lambda *h: F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("text")) for a, b in h])
    paths = lambda *h: [r["path"] for r in value(spark, tx.toc_paths(F.col("h")), h=heads(*h))]
    assert paths((1, "A"), (2, "B"), (1, "C")) == ["A", "A > B", "C"]
    assert paths((1, "A"), (3, "D")) == ["A", "A > D"]
    assert paths((0, "A"), (0, "B")) == ["A", "B"]


def test_rewrites_and_templates(spark):
    assert value(spark, tx.accept_rewrite(F.lit("q"), F.lit("  ab "))) == "q"
    assert value(spark, tx.accept_rewrite(F.lit("q"), F.lit(" abc "))) == "abc"
    assert value(spark, tx.simple_rewrite(F.lit("q"), F.lit("无"))) == "q"
    assert value(spark, tx.fill_template(F.lit("a {x} b"), {"x": F.lit("1")})) == "a 1 b"
    assert value(spark, tx.fill_template(F.lit("a {x} {y}"), {"x": F.lit("1")})) == "a {x} {y}"
    assert value(spark, tx.summary_bypass(F.lit("ab"), 2)) == "ab..."
    assert value(spark, tx.hamming(F.lit(7), F.lit(1))) == 2
    assert abs(value(spark, tx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) - 1) < 1e-6


def test_labels(spark):
    assert value(spark, tx.reference_label(F.lit("f"), F.lit("3"), F.lit("K"))) == "f (第3页) [K]"
    assert value(spark, tx.reference_label(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"))) == "未知"
    assert value(spark, tx.context_block(F.lit("f"), F.lit("3"), F.lit(""), F.lit("abc"), Params(chunk_size=2))) == "[来源: f, 第3页]\nab"
    assert value(spark, tx.image_markdown(F.lit("f"), F.lit("extracted_images\\u\\1.png"))) == "![f](http://127.0.0.1:8000/images/u/1.png)"


def test_markdown():
    text, toc = parse_markdown("# A\n\nx **b** [t](u) ![a](u)\nmore\n\n## B\n\n- x\n  - y\n- [x] z\n\n1. q\n2. r\n\n> w\n> v\n\n```py\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n# C\n### D\n\n<div>gone</div>\n")
    assert [t[2] for t in toc] == ["A", "A > B", "C", "C > D"]
    assert text.split("\n\n") == ["# A", "x b t [图: a] more", "## B", "• x", "    • y", "☑ z", "1. q", "2. r", "> w v", "[代码块 py]\ncode\n[/代码块]", "| a | b |\n| --- | --- |\n| 1 | 2 |", "---", "# C", "### D"]


def test_paths_of_very_many_headings(spark):
    import time

    from corpusmill.sources.loaders import paths_of

    n = 200_000
    level = lambda k: (k * 7919 + k // 3) % 6
    one = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(((k * 7919 + F.floor(k / 3)) % 6).cast("int").alias("level"), k.cast("string").alias("text"))).alias("h"))
    began = time.time()
    got = one.select(F.transform(tx.toc_paths(F.col("h")), lambda r: F.concat_ws(":", r["level"], r["path"])).alias("p")).first()["p"]
    assert time.time() - began < 30
    assert got == [f"{r['level']}:{r['path']}" for r in paths_of([(max(1, level(k)), str(k)) for k in range(n)])]


def test_scans_of_no_and_of_null_items(spark):
    rows = spark.createDataFrame([([],), (None,), ([(1, "a")] * 1025,)], "h array<struct<level:int,text:string>>").select(tx.toc_paths(F.col("h")).alias("p")).collect()
    assert [r["p"] if r["p"] is None else len(r["p"]) for r in rows] == [0, None, 1025]
