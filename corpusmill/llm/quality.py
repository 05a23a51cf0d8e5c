"""Quality rules: line-first cleaning, in DataFrame operations only.

Every line is judged by rules of punctuation, navigation and boilerplate;
failing lines are removed, and a document that loses too much of its text, or
breaks one of the document rules, is rejected. Everything about a document is
worked out inside its own row, so nothing is shuffled.

Defined results
* null text: no words, fails the document rule of length
* empty and blank-only texts: the same
* blank lines: neither judged nor counted
* very long texts: all lines and all windows count, whatever their number
* repeated rows and ties: each row is judged by itself
* empty table: empty result
* extra or clashing columns: carried by ``clean_lines``, never looked at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Document rules.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A document stays only if at least this share of its word characters is on lines that stay.
MIN_KEPT_PERCENT = 50



def either_case(phrase: str) -> str:
    """A pattern for a phrase in upper and lower ASCII letters, the same in every dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in phrase)


#: Patterns that make a line fail. Portable between regular expression dialects.
#: A line without sentence punctuation has none of ASCII, which is looked for first, and none of other scripts: full width and vertical; Arabic and Urdu; Devanagari and its neighbours; Ethiopic; Armenian; Burmese; Khmer; Tibetan.
UNPUNCTUATED = r"^[^.!?:;]*$"
MARKS = "…" + "。．！？：；｡︒" + "؟؛۔" + "।॥" + "።፧፨" + "։՞՜" + "၊။" + "។៕" + "།༎"
#: Scripts that end sentences with a space: Thai and Lao.
UNMARKED = "ก-๛ກ-ໟ"
OTHER_MARKS = f"[{MARKS}{UNMARKED}]"
SHOUTING = r"(!![^\n]*){3}"
SYMBOLS = r"([#*$%&<>]{2}[^\n]*){3}"
#: Parts between bars, arrows or dots, as of menus and paths.
NAVIGATION = r"([|»›·•→][^\n]*){3}"
#: Phrases of notices, in the languages of the corpus, and such that only count in short lines.
NOTICES = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl",
    "tous droits r", "conditions d.utilisation", "politique de confidentialit", "todos los derechos reservados", "condiciones de uso", "pol.tica de privacidad",
)
CALLS = (
    "copyright", "cookie", "subscribe", "newsletter", "javascript", "click here", "sign in", "sign up", "log in", "read more", "share this",
    "anmelden", "abonnieren", "weiterlesen", "hier klicken", "se connecter", "abonnez-vous", "lire la suite", "cliquez ici", "iniciar sesi", "suscr.bete", "leer m.s", "haga clic",
)
BOILERPLATE, CALL = (f"({'|'.join(map(either_case, x))})" for x in (NOTICES, CALLS))
#: A call fails a line of less than this many characters only: prose may speak of cookies.
CALL_CHARS = 60
#: A line without sentence punctuation fails only from this many characters on: short headings stay.
HEADING_CHARS = 80


def _held(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once: an optimiser may not copy them into the lambdas that read them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def line_fails(line: Column) -> Column:
    return (
        (F.length(line) >= HEADING_CHARS) & line.rlike(UNPUNCTUATED) & ~line.rlike(OTHER_MARKS)
        | line.rlike(SHOUTING)
        | line.rlike(SYMBOLS)
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
        | (F.length(line) < CALL_CHARS) & line.rlike(CALL)
    )


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of measures and the verdict for each row of docs, in whichever partition it lies."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = _held(df, lines=F.filter(F.split("t", "\n", -1), lambda x: F.length(common.without_blanks(x)) > 0))
    df = _held(
        df,
        words=F.regexp_extract_all("t", F.lit(common.WORD), F.lit(0)),
        word_chars=F.length(common.without_blanks(F.col("t"))).cast("long"),
        n_symbols=F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        kept_chars=F.aggregate(
            F.filter("lines", lambda x: ~line_fails(x)),
            F.lit(0).cast("long"),
            lambda n, x: n + F.length(common.without_blanks(x)),
        ),
    ).drop("t", "lines")
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)])
    df = _held(
        df,
        n_words=n.cast("long"),
        grams=F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>")),
    )
    # only a row with two equal windows is worth sorting
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    placed = F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    df = _held(df, s=F.when(twice, F.sort_array(placed)).otherwise(none)).drop("grams")

    def alike(a: Column, b: Column) -> Column:
        """Equal hashes of equal words."""
        same = a["g"] == b["g"]
        for k in range(5):
            same = same & (F.get("words", a["i"] + k) == F.get("words", b["i"] + k))
        return F.coalesce(same, F.lit(False))

    df = _held(df, eq=F.zip_with("s", F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1))), alike)).drop("words")
    again = F.filter("s", lambda x, k: F.get("eq", k) | F.coalesce(F.get("eq", k - 1), F.lit(False)))
    df = _held(df, at=F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s", "eq")
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda p, q: F.when(p.isNull(), 0).otherwise(F.least(F.lit(5), F.coalesce(q - p, F.lit(5)))))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= MIN_KEPT_PERCENT * F.col("word_chars"))
    )


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with failing lines taken out of the text; null stays null."""
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~line_fails(x))
    return docs.withColumn(text_col, F.array_join(lines, "\n"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {common.sql_words('text')} AS w FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
g AS (
  SELECT doc_id, line, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS solid FROM l),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(length(solid)) FILTER (WHERE NOT (
           (length(line) >= {HEADING_CHARS} AND regexp_matches(line, '{UNPUNCTUATED}') AND NOT regexp_matches(line, '{OTHER_MARKS}'))
           OR regexp_matches(line, '{SHOUTING}') OR regexp_matches(line, '{SYMBOLS}')
           OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}')
           OR (length(line) < {CALL_CHARS} AND regexp_matches(line, '{CALL}')))), 0) AS kept_chars
  FROM g WHERE length(solid) > 0 GROUP BY doc_id),
p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM p),
y AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM x),
z AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM y WHERE n > 1),
r AS (
  SELECT doc_id, sum(step) AS n_repeat_words FROM z GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(kept_chars, 0) AS kept_chars
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM v
"""
