"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over every labelled row outside the held-out fold, summed in
a tree, and turned into one matrix of log-probabilities (buckets x languages)
and the log priors of the languages, which are broadcast. A batch of texts is
a sparse matrix of counts by bucket, which is multiplied with that matrix in
numpy.

The matrix is bounded to MATRIX_BYTES: with many languages n-grams are hashed
to fewer buckets, so no number of languages fails.

Defined results
* null text, or a text without a letter: ``und`` with score 0
* very long texts: whole, in pieces of at most PIECE_CHARS places, whose counts add up
* null lang: not learned from; null doc_id: as the id '' when folds are dealt
* no labelled row at all: every text is ``und``
* ties: the language that sorts first
* a text's result does not depend on the texts around it
* repeated rows, empty tables: row by row; extra or clashing columns: not looked at
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDERS = (1, 2, 3)
#: Bits of a bucket at most, and bytes of the broadcast matrix, which decide on them together.
BITS = 14
MATRIX_BYTES = 100 << 20
SMOOTHING = 0.5
#: Characters of texts, and places of one text, that are taken at once.
SLICE_CHARS = 2_000_000
PIECE_CHARS = 500_000
#: Numbers that a product holds at once.
AT_ONCE = 4_000_000
#: Number of partial sums that each count is gathered from.
FAN_IN = 64
UNKNOWN = "und"
_MIX = np.uint32(2654435769)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, if it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length with the number of their first."""
    run: list[str] = []
    first = size = 0
    for k, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > SLICE_CHARS:
            yield first, run
            run, first, size = [], k, 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of pieces (number of the text, string) of bounded length. A piece has the ORDERS[-1] - 1 characters behind it, too; each text stands between blanks."""
    more = ORDERS[-1] - 1
    own: list[int] = []
    run: list[str] = []
    size = 0
    for k, t in enumerate(texts):
        s = f" {(t or '').lower()}{' ' * more}"
        for at in range(0, len(s) - more, PIECE_CHARS):
            own.append(k)
            run.append(s[at : at + PIECE_CHARS + more])
            size += len(run[-1])
            if size >= PIECE_CHARS:
                yield np.array(own), run
                own, run, size = [], [], 0
    if run:
        yield np.array(own), run


def ngrams(run: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, bucket over all orders, has the piece a letter) of every n-gram. Whatever is no letter counts as a blank."""
    more = ORDERS[-1] - 1
    code = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, run), np.int64, len(run))
    start = np.cumsum(size) - size
    letter = letters()[code]
    code = np.where(letter, code, np.uint32(32))
    piece = np.repeat(np.arange(len(run)), size - more)
    at = np.arange(len(piece)) + piece * more
    h, out = code[at], []
    for k, order in enumerate(ORDERS):
        if k:
            h = h * np.uint32(0x01000193) ^ code[at + order - 1]
        out.append((h * _MIX >> np.uint32(32 - bits)).astype(np.int32) + np.int32(k << bits))
    return np.tile(piece, len(ORDERS)), np.concatenate(out), np.logical_or.reduceat(letter, start)


def sparse_counts(row: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count), in order of rows."""
    key, count = np.unique(row.astype(np.int64) * buckets + bucket, return_counts=True)
    return key // buckets, key % buckets, count


_COUNTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("salt", pa.int32()), ("rows", pa.int64()), ("counts", pa.binary())])


def count_ngrams(labelled: DataFrame, bits: int) -> DataFrame:
    """(lang, part: the order, rows, counts as packed int64) over rows of (lang, text)."""
    common.text_batches(labelled.sparkSession)
    buckets = len(ORDERS) << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: Counter[str] = Counter()
        salt = 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            rows.update(langs)
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs] if len(names) < 32 else np.searchsorted(np.array(names), np.array(langs)), np.int64)
            for own, run in pieces(batch.column(1).to_pylist()):
                salt += sum(map(len, run))
                piece, bucket, _ = ngrams(run, bits)
                lang, at, n = sparse_counts(of[own][piece], bucket, buckets)
                for k in np.unique(lang).tolist():
                    total.setdefault(names[k], np.zeros(buckets, np.int64))[at[lang == k]] += n[lang == k]
        out = [(name, k, salt % FAN_IN, rows[name] if k == 0 else 0, c[k << bits : (k + 1) << bits].tobytes()) for name, c in total.items() for k in range(len(ORDERS))]
        yield pa.RecordBatch.from_pylist([dict(zip(_COUNTS.names, r, strict=True)) for r in out], _COUNTS)

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"lang": [key[0]], "part": [key[1]], "salt": [0], "rows": [pdf["rows"].sum()], "counts": [total.tobytes()]})

    kind = "lang string, part int, salt int, rows long, counts binary"
    parts = labelled.mapInArrow(count, kind)
    return parts.groupBy("lang", "part", "salt").applyInPandas(add, kind).groupBy("lang", "part").applyInPandas(add, kind)


@dataclass
class Model:
    langs: list[str]
    bits: int
    prior: np.ndarray  # log, by language
    matrix: np.ndarray  # log-probabilities, buckets x languages


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows of docs with a language and a text."""
    labelled = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    n = labelled.select("lang").distinct().count()
    bits = max(1, min(BITS, int(math.log2(max(2, MATRIX_BYTES // (4 * len(ORDERS) * max(1, n)))))))
    rows = count_ngrams(labelled, bits).select("lang", "part", "rows", "counts").toLocalIterator()
    counts: dict[tuple[str, int], np.ndarray] = {}
    seen: Counter[str] = Counter()
    for r in rows:
        c = np.frombuffer(r["counts"], np.int64) + SMOOTHING
        counts[r["lang"], r["part"]] = np.log(c / c.sum()).astype(np.float32)
        seen[r["lang"]] += r["rows"]
    langs = sorted(seen)
    matrix = np.empty((len(ORDERS) << bits, len(langs)), np.float32)
    for j, name in enumerate(langs):
        for k in range(len(ORDERS)):
            matrix[k << bits : (k + 1) << bits, j] = counts.pop((name, k))
    prior = np.log(np.array([seen[x] for x in langs], float) / max(1, sum(seen.values())))
    return Model(langs, bits, prior, matrix)


def score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text."""
    langs, buckets = model.langs, len(ORDERS) << model.bits
    if not langs or not texts:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total = np.tile(model.prior, (len(texts), 1))
    known = np.zeros(len(texts), bool)
    step = max(1, AT_ONCE // len(langs))
    for own, run in pieces(texts):
        piece, bucket, letter = ngrams(run, model.bits)
        np.logical_or.at(known, own, letter)
        text, at, n = sparse_counts(own[piece], bucket, buckets)
        for k in range(0, len(text), step):
            t = text[k : k + step]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            total[t[first]] += np.add.reduceat(model.matrix[at[k : k + step]] * n[k : k + step, None], first, axis=0, dtype=np.float64)
    best = total.argmax(1)
    p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [langs[k] if x else UNKNOWN for k, x in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p, 0.0).tolist()


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    spark = docs.sparkSession
    common.text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("doc_id"), common.held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~common.held_out(docs["doc_id"]))))
