"""Every registered query runs over the supplied tables and agrees with its SQL."""

import pytest
from conftest import TESTDATA, assert_same

from corpusmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert_same(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, TESTDATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _two_texts(spark, path, a, b):
    rows = [(1, a, "en", "s", len(a)), (3, b, "en", "s", len(b))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_mixed_pages_hold_whole_texts(spark, tmp_path):
    at = _two_texts(spark, tmp_path, "x" * 80 + "a", "x" * 80 + "b")
    assert len({r["md5"] for r in catalog.QUERIES["mixed_pages_whole"](spark, at).collect()}) == 2


def test_toc_paths_hold_whole_lines(spark, tmp_path):
    at = _two_texts(spark, tmp_path, "x" * 8 + "a", "x" * 8 + "b")
    assert len({r["md5"] for r in catalog.QUERIES["toc_paths_whole"](spark, at).collect()}) == 2
