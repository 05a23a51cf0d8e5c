"""A training-data pipeline of five stages, each of which calls one operator.

Stages are given the rows that their predecessor kept and return the columns
of documents, but for the last, which returns what was encoded. Each result is
written as Parquet into the shared folder and read again as the next input.

Defined results of every stage
* null, empty and very long texts, null and repeated ids, extra and clashing
  columns: as the docstring of the stage's operator says; all columns are
  carried but by the last stage
* an empty table: an empty result
* a lost executor: Spark's committers leave no half of a stage's table behind
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import common, exact_dedup, mixing, near_join, sentencepieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; labels are learned from the tables, outside the held-out fold. Null and empty texts have the score of a text without words; without labels nothing goes."""
    index = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, index)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, blanks apart, the longest stays, of these the one with the smallest id; null and empty texts are one group."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 or more over five words, the one with the smallest id stays. Texts without words and rows without an id are joined with nothing; rows that share an id but not their text are documents of their own."""
    return near_join.drop_near_copies(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, every document stays at least once; a null source is a source of its own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; null texts are empty ones."""
    return sentencepieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the nearest labelled examples of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
