"""What a hybrid search moves and makes."""

from conftest import TESTDATA

from corpusmill.operators import keyword
from corpusmill.plans import retrieval_queries, search
from corpusmill.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_terms_are_taken_apart_once(spark):
    """Postings and query terms are made in the search's plan; numbers of chunks by term are counted before, once, and asked terms too."""
    found = plan(keyword.keyword_topk(tables.chunks(spark, TESTDATA), tables.queries(spark, TESTDATA)))
    assert found.count("Generate ") == 2
    # asked terms come to the postings
    assert any("LeftSemi" in line and "BroadcastHashJoin" in line for line in found.splitlines())


def test_texts_are_not_shuffled(spark):
    """Results come to the texts, even where Spark takes little for small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        chunks = tables.table(spark, TESTDATA, "documents").selectExpr("source AS user_id", "doc_id AS chunk_id", "text")
        found = plan(search.hybrid_search(chunks, tables.vectors(spark, TESTDATA), retrieval_queries.embedded_queries(spark, TESTDATA), threshold=0.9))
        assert "SortMergeJoin" not in found and found.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
