"""Plans are what they should be: pushed filters, pruned columns, early cuts, no all-pairs joins."""

import re

import pytest
from conftest import TESTDATA, rows_of
from pyspark.sql import functions as F

from corpusmill.operators import keyword
from corpusmill.plans import catalog, retrieval_queries
from corpusmill.sources import tables

STREAMS = {n for n in catalog.QUERIES if n.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_no_all_pairs(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(catalog.QUERIES[name](spark, TESTDATA)))


def test_vectors_are_read_without_texts(spark):
    p = plan(tables.vectors(spark, TESTDATA))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p and "text" not in p


def test_tenant_filter_is_pushed(spark):
    p = plan(tables.table(spark, TESTDATA, "documents").where(F.col("source") == "src3").select("doc_id"))
    assert "EqualTo(source,src3)" in p and "ReadSchema: struct<doc_id:bigint,source:string>" in p


def test_top_k_is_cut_before_the_shuffle(spark):
    p = plan(retrieval_queries.bm25_topk(spark, TESTDATA))
    assert p.count("WindowGroupLimit") == 2


def test_cleaning_moves_nothing_but_the_spread(spark):
    p = plan(catalog.QUERIES["clean_text"](spark, TESTDATA))
    assert p.count("Exchange") <= 1 and "Python" not in p


def test_kept_index(spark, tmp_path):
    chunks, q = tables.chunks(spark, TESTDATA), tables.queries(spark, TESTDATA)
    keyword.write_index(keyword.term_tables(chunks), str(tmp_path))
    index = keyword.read_index(spark, str(tmp_path))
    got = keyword.keyword_topk(chunks, q, index=index).withColumn("score", F.round("score", 6))
    want = keyword.keyword_topk(chunks, q).withColumn("score", F.round("score", 6))
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())
    one = plan(keyword.keyword_topk(chunks, q.where("user_id = 'src1'"), index=index))
    assert re.search(r"/postings\], PartitionFilters: \[[^\]]*user_id", one), re.findall(r"PartitionFilters: .{80}", one)
