"""Exact de-duplication by content-defined chunk recipes, in DataFrame operations only.

Each text, freed of blanks, is cut where its own content says so: two
bytes of its UTF-8 with low digits 0 or 1 end a chunk, whatever the script. A chunk is known by a 64-bit hash that is verified by SHA-256 over all
chunks of the corpus: different contents under one hash get different
ordinals. A document is then an ordered list of verified identifiers (its
recipe), and equal recipes are equal texts. To find the groups, texts are read
once and never shuffled; only digests move. ``exact_dedup`` moves whole rows
once, equal ones together before they leave their task.

Defined results
* null text: the empty text; empty and blank-only texts form one group
* ids of any type that has an order; null doc_id: behind all ids in ties
* repeated rows: members of their group like any other, of which one stays
* very long texts: longer recipes, nothing else
* empty table: empty result
* extra or clashing columns: carried by ``exact_dedup``, never looked at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: In hexadecimal digits: a chunk ends behind the first such two bytes after 256, or at 2,048. No letter or digit of any script always has them.
CHUNK = r".{512,4092}?(?:.[01]){2}|.{1,4096}"


def _row_key(id_: Column, raw: Column) -> Column:
    """A digest of id and raw text, the same for equal rows alone."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("i"), F.sha2(id_.cast("string"), 256)), F.lit("-")), raw), 256))


def _digests(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row of digests for each row: u, doc_id, n_chars, exact (of id and raw text), text_sha256, chunks."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("raw"))
        .withColumn("norm", common.without_blanks(F.col("raw")))
        .select(
            F.monotonically_increasing_id().alias("u"),
            "doc_id",
            F.length("raw").cast("long").alias("n_chars"),
            _row_key(F.col("doc_id"), F.col("raw")).alias("exact"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(
                F.regexp_extract_all(F.hex("norm"), F.lit(CHUNK), F.lit(0)),
                lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("v")),
            ).alias("chunks"),
        )
    )


def chunk_identifiers(chunks: DataFrame) -> DataFrame:
    """Distinct chunks (h, v) with ``o``, the ordinal of v among the contents that share h."""
    by_hash = Window.partitionBy("h").orderBy("v")
    return chunks.groupBy("h", "v").agg(F.count(F.lit(1)).alias("uses")).withColumn("o", F.row_number().over(by_hash))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, exact, text_sha256, keep_id, group_size, kept."""
    base = common.stored(_digests(docs, text_col, id_col), "digests")
    chunks = base.select("u", F.posexplode("chunks").alias("pos", "c")).select("u", "pos", "c.h", "c.v")
    known = common.stored(chunk_identifiers(chunks), "chunks").select("h", "v", "o")
    lists = (
        chunks.join(known, ["h", "v"])
        .groupBy("u")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h", "o"))).alias("steps"))
        .select("u", F.transform("steps", lambda s: F.struct(s["h"].alias("h"), s["o"].alias("o"))).alias("recipe"))
    )
    nothing = F.array().cast("array<struct<h:bigint,o:int>>")
    recipes = common.stored(
        base.drop("chunks").join(lists, "u", "left").withColumn("recipe", F.coalesce("recipe", nothing)), "recipes"
    )
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "u"))
    groups = common.stored(
        recipes.groupBy("recipe")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("recipe", "group_size", F.col("best.u").alias("keep_u"), F.col("best.doc_id").alias("keep_id")),
        "groups",
    )
    return recipes.join(groups, "recipe").select(
        "doc_id", "exact", "text_sha256", "keep_id", "group_size", (F.col("u") == F.col("keep_u")).alias("kept")
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    keys = exact_groups(docs, text_col, id_col).where("kept").select(F.col("exact").alias("_key"))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    held = held.withColumn("_key", _row_key(F.col(f"row.`{id_col}`"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))))
    # rows with one key meet before the shuffle, which the join then shares
    one = held.groupBy("_key").agg(F.first("row").alias("row")).join(keys, "_key", "left_semi")
    return one.select([F.col(f"row.`{c}`").alias(c) for c in names])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
