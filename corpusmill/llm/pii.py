"""Personal data: exact base rules, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy from labelled spans: windows around base
spans and secrets of a bounded sample of documents, and templates of the same
kinds in other spellings. Every character of every text goes through it, in
windows that overlap. The scores of windows that overlap are averaged, nearer
to their middles more, and one best path through the scores of the whole text
gives its tags, so transitions hold across windows. Where no run of other tags
around a place could make up for the lead of tag 0, which is most of a text,
the path has tag 0 for certain; only the rest goes through Viterbi's algorithm.

The network finds the kinds of the base rules in other spellings, and secrets
(tokens, keys, passwords), which no base rule knows. A span that it adds must
hold its kind and must not touch a base span; base spans are never changed.

Defined results
* null and empty texts: no spans
* very long texts and runs: whole, in time that grows with their length
* the edges of a text count as tag 0
* the same value twice: two spans
* repeated rows, null ids, empty tables: row by row, as they come
* extra or clashing columns: carried by ``redact``, else not looked at
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .langid import letters, slices
from .lstm_crf import PAD, LstmCrf, best_path

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the network tags.
TAGGED = (*KINDS, "secret")
#: The patterns of the base rules, those of e-mail addresses and of addresses of machines in parts.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: How secrets are announced in documents that windows for training are taken from.
SECRET = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|password)[\x20\"':=]{1,4}([A-Za-z0-9+/_-]{16,})")

#: Documents that windows for training are looked for in, and are taken from, at most: those whose contents have the smallest hashes.
TRAIN_LOOKED = 6_000
TRAIN_DOCS = 300
#: Labelled spans of a document that windows are cut around, and characters of such a window, at most.
TRAIN_SPANS = 6
TRAIN_WINDOW = 64
TEMPLATES = 500
EPOCHS = 14
WINDOW = 256
OVERLAP = 32
#: Windows that are read at once, and whose scores are kept (6 KB each) until it is known which places are open; of more, those that are needed are read again.
AT_ONCE = 1024
KEPT = 16_384
_digit = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the base rule, leftmost and non-overlapping, each found from its @ sign: linear in the text."""
    edge = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > edge and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            edge = m.end()
        else:
            edge = max(edge, at + 1)
        at = text.find("@", max(edge, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers each out of every run of numbers with dots, of which no part exceeds 255."""
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in own):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _digit.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() > 2 * 19:  # a separator for each digit at most
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


#: Looser spellings in which an added span must hold its kind. A part of an address has 64 characters at most.
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,64})+"),
    "ip": re.compile(r"(?<![0-9])([0-9]{1,3})(?:\[\.\]|\(\.\)| \. )([0-9]{1,3})(?:\[\.\]|\(\.\)| \. )([0-9]{1,3})(?:\[\.\]|\(\.\)| \. )([0-9]{1,3})(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20._/\xa0-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?:\(?00[1-9][0-9]{0,2}\)?|\([0-9]{2,4}\)|(?<![0-9])[0-9]{2,4})(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"),
}
#: A secret has so many different characters, letters and digits among them.
SECRET_CHARS = 8


def plausible(kind: str, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where a run that was tagged holds its kind in a looser spelling."""
    for m in LOOSE[kind].finditer(text, start, end):
        if kind == "secret":
            chars = set(m[0])
            right = len(chars) >= SECRET_CHARS and any(c.isdigit() for c in chars) and any(c.isalpha() for c in chars)
        else:
            digits = "".join(c for c in m[0] if c in "0123456789")
            right = {"email": True, "ip": kind == "ip" and all(int(g) <= 255 for g in m.groups()), "card": luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
        if right:
            yield m.start(), m.end()


QUOTE = '"'


def symbols(texts: list[str]) -> np.ndarray:
    """The network's symbols of texts in a row."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, code, np.where(letters()[code], 128, 129)).astype(np.uint8)


def template_windows(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up windows with labelled spans in several spellings, and some without."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    digits = lambda k: "".join(str(int(c)) for c in rng.integers(0, 10, k))
    out = []
    for _ in range(n):
        kind = pick("email", "ip", "card", "phone", "secret", "")
        if kind == "email":
            value = f"{word()}{pick('', '.', '_')}{pick('', digits(2))}{pick('@', '@', ' @ ', ' [at] ', ' (at) ')}{word()}{pick('.', '.', ' [dot] ', ' (dot) ')}{pick('com', 'org', 'net', word())}"
        elif kind == "ip":
            value = pick(".", ".", "[.]", "(.)", " . ").join(str(int(x)) for x in rng.integers(0, 256, 4))
        elif kind == "card":
            value = pick("", " ", "-", ".", "/").join(digits(4) for _ in range(4))
        elif kind == "phone":
            sep = pick(" ", "-", ".", "/")
            value = pick(f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}){sep}{digits(3)}{sep}{digits(4)}", sep.join([digits(3), digits(3), digits(4)]), f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}")
        elif kind == "secret":
            signs = pick("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
            value = "".join(signs[int(c)] for c in rng.integers(0, len(signs), int(rng.integers(16, 41))))
        else:
            value = pick(word(), digits(int(rng.integers(1, 7))), f"{digits(1)}.{digits(2)}", f"{word()}.{word()}", f"{pick(*'#$%&*')} {word()}")
        head = " ".join(word() for _ in range(int(rng.integers(0, 6)))) + pick(" ", " ", "\n", ": ")
        if kind == "secret":
            head = f"{pick('', head[:8])}{pick('token', 'secret', 'api_key', 'password', 'TOKEN')}{pick(' = ', ': ', '=')}{pick('', QUOTE)}"
        text = head + value + pick(" ", ", ", ".", "\n") + " ".join(word() for _ in range(8))
        out.append((text[:TRAIN_WINDOW], [(kind, len(head), len(head) + len(value))] if kind and len(head) + len(value) <= TRAIN_WINDOW else []))
    return out


def examples(windows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (windows, time)."""
    x = np.full((len(windows), TRAIN_WINDOW), PAD, np.int64)
    y = np.zeros((len(windows), TRAIN_WINDOW), np.int64)
    for k, (text, spans) in enumerate(windows):
        x[k, : len(text)] = symbols([text])
        for kind, a, b in spans:
            y[k, max(a, 0) : b] = TAGGED.index(kind) + 1
    return x, y


def around(text: str, turn: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows around the first labelled spans of a text, and one without any; turn: a number that places them."""
    spans = base_spans(text)
    secrets = [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text)]
    spans = sorted(spans + [x for x in secrets if all(x[2] <= a or x[1] >= b for _, a, b in spans)], key=lambda x: x[1])
    out = []
    for k, (_, a, b) in enumerate([x for x in spans if x[2] - x[1] <= TRAIN_WINDOW - 4][:TRAIN_SPANS]):
        begin = max(0, a - (turn * 7 + k * 13) % (TRAIN_WINDOW - (b - a)))
        end = begin + TRAIN_WINDOW
        if not any(s < begin < e or s < end < e for _, s, e in spans):
            out.append((text[begin:end], [(kind, s - begin, e - begin) for kind, s, e in spans if s >= begin and e <= end]))
    begin = (turn * 101) % max(1, len(text) - TRAIN_WINDOW)
    if not any(s < begin + TRAIN_WINDOW and e > begin for _, s, e in spans):
        out.append((text[begin : begin + TRAIN_WINDOW], []))
    return out


def labelled_windows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of a bounded sample of documents. Only hashes are sorted, and only windows leave the executors."""
    text = docs[text_col]
    some = docs.where(text.isNotNull()).select(F.xxhash64(docs[id_col].cast("string"), text).alias("h"), text.alias("text"))
    chosen = some.groupBy("h").agg(F.lit(1)).select(F.col("h").alias("c")).orderBy("c").limit(TRAIN_LOOKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for h, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                windows = around(own, h % 9973)
                keep.append(any(spans for _, spans in windows))
                found.append([{"text": t, "spans": [dict(zip(("kind", "start", "end"), x, strict=True)) for x in s]} for t, s in windows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _WINDOWS)], ["h", "windows"]).filter(pa.array(keep, pa.bool_()))

    rows = some.join(F.broadcast(chosen), F.col("h") == F.col("c")).select("h", "text").mapInArrow(run, "h long, windows array<struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>>")
    one = rows.groupBy("h").agg(F.min("windows").alias("windows")).orderBy("h").limit(TRAIN_DOCS).collect()  # equal rows once; a few windows each
    return [(w["text"], [tuple(s) for s in w["spans"]]) for r in one for w in r["windows"]]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_WINDOWS = pa.list_(pa.struct([("text", pa.string()), ("spans", pa.list_(_SPAN))]))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> LstmCrf:
    """The network, trained on at most TRAIN_DOCS x (TRAIN_SPANS + 1) windows of documents and on TEMPLATES made-up ones."""
    common.text_batches(docs.sparkSession)
    windows = labelled_windows(docs, text_col, id_col) + template_windows(np.random.Generator(np.random.PCG64(11)), TEMPLATES)
    model = LstmCrf(len(TAGGED) + 1)
    model.fit(*examples(windows), EPOCHS)
    return model


def best_run(v: np.ndarray) -> np.ndarray:
    """By position, the largest sum of a run of values that holds it."""
    total = np.cumsum(v, dtype=np.float64)
    before = np.minimum.accumulate(np.r_[0.0, total[:-1]])
    after = np.maximum.accumulate(total[::-1])[::-1]
    return after - before


def tagged(model: LstmCrf, texts: list[str]) -> dict[int, list[tuple[str, int, int]]]:
    """(kind, start, end) of the runs of a tag in each text that has any."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    flat = symbols(texts)
    if not len(flat):
        return {}
    step = WINDOW - OVERLAP
    count = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // step)), 0)
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place, end = begin[text] + number * step, begin[text] + size[text]
    time, tags = np.arange(WINDOW)[:, None], model.tags
    rise = (np.arange(OVERLAP, dtype=np.float32) + 0.5) / OVERLAP

    whole = place + WINDOW <= end

    def placed(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, weight) of windows; places behind a text are those behind all texts."""
        at = place[own] + time
        if not whole[own].all():
            at = np.where(at < end[own], at, len(flat))
        weight = np.ones((WINDOW, len(own)), np.float32)
        weight[:OVERLAP, number[own] > 0] *= rise[:, None]
        weight[-OVERLAP:, number[own] + 1 < count[text[own]]] *= 1 - rise[:, None]
        return at, weight

    def read(windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, scores) in turns in which no place occurs twice."""
        for k in range(0, len(windows), AT_ONCE):
            for half in (0, 1):
                own = windows[k : k + AT_ONCE]
                own = own[number[own] % 2 == half]
                if len(own):
                    yield own, model.emissions(padded[placed(own)[0]])

    padded = np.r_[flat, np.uint8(PAD)].astype(np.intp)
    gain, least = model.gain()
    lead = np.zeros(len(flat) + 1, np.float32)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for own, e in read(np.arange(len(text))):
        at, weight = placed(own)
        if len(text) <= KEPT:
            kept.append((own, e))
        most = e[:, 1] + gain[0]
        for k in range(2, tags):
            np.maximum(most, e[:, k] + gain[k - 1], out=most)
        most -= e[:, 0]
        lead[at] += most * weight
    lead = lead[:-1]
    open_ = best_run(lead) + least > 0
    position = np.flatnonzero(open_)
    if not len(position):
        return {}
    mine = np.searchsorted(begin + size, position, "right")
    window = (np.cumsum(count) - count)[mine] + np.minimum((position - begin[mine]) // step, count[mine] - 1)
    shared = (number[window] > 0) & (position - place[window] < OVERLAP)
    score, rank = np.zeros((len(position), tags), np.float32), np.cumsum(open_) - 1  # rank of a place among the open ones
    open_ = np.append(open_, False)
    wanted = np.union1d(window, window[shared] - 1)
    held = ((own[mine], e[:, :, mine]) for own, e in kept if (mine := np.isin(own, wanted)).any())
    for own, e in held if kept else read(wanted):
        at, weight = placed(own)
        ok = open_[at]
        score[rank[at[ok]]] += e.swapaxes(1, 2)[ok] * weight[ok, None]
    # one chain of all runs of open positions, each behind a place that has tag 0 for certain
    apart = np.flatnonzero(np.r_[True, (np.diff(position) > 1) | np.isin(position[1:], begin)][: len(position)])
    certain = np.r_[np.float32(0), np.full(tags - 1, -1e6, np.float32)]
    to = np.arange(len(position)) + np.searchsorted(apart, np.arange(len(position)), "right")
    chain = np.tile(certain, (len(position) + len(apart) + 1, 1))
    chain[to] = score
    path = best_path(chain, model.fast["move"])[to]
    out: dict[int, list[tuple[str, int, int]]] = {}
    edge = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (np.diff(position) > 1) | np.isin(position[1:], begin)][: len(path)])
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(path)], strict=True):
        if path[a]:
            t = int(np.searchsorted(begin, position[a], "right")) - 1
            out.setdefault(t, []).append((TAGGED[path[a] - 1], int(position[a] - begin[t]), int(position[b - 1] - begin[t]) + 1))
    return out


#: Characters by which a tag may miss the edge of its value.
NEAR = 4


def all_spans(model: LstmCrf, texts: list[str]) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    found = tagged(model, texts)
    for k, text in enumerate(texts):
        base = base_spans(text)
        added: list[tuple[str, int, int]] = []
        if k in found:
            taken = sorted((s, e) for _, s, e in base)
            starts, ends = np.array([s for s, _ in taken], np.int64), np.maximum.accumulate(np.array([e for _, e in taken], np.int64))
            for kind, a, b in found[k]:
                for a_, b_ in plausible(kind, text, max(0, a - NEAR), min(len(text), b + NEAR)):
                    n = int(np.searchsorted(starts, b_))  # base spans that begin before it ends
                    if (not n or ends[n - 1] <= a_) and (not added or added[-1][2] <= a_):
                        added.append((kind, a_, b_))
        yield base, sorted(base + added, key=lambda s: (TAGGED.index(s[0]), s[1])) if added else base


def detect(docs: DataFrame, model: LstmCrf, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points) of each row of docs."""
    spark = docs.sparkSession
    common.text_batches(spark)
    shared = spark.sparkContext.broadcast(model.params)
    tags, hidden = model.tags, model.hidden
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LstmCrf(tags, hidden, params=shared.value)
        own.ready()
        for batch in batches:
            base, spans = [], []
            for _, texts in slices(batch.column(1).to_pylist()):
                for b, s in all_spans(own, texts):
                    base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
                    spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "base", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are one, of the kind that begins first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: LstmCrf, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, each span of the text replaced by its kind in square brackets; null stays null. One pass, nothing is shuffled or joined."""
    spark = docs.sparkSession
    common.text_batches(spark)
    shared = spark.sparkContext.broadcast(model.params)
    tags, hidden, at = model.tags, model.hidden, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LstmCrf(tags, hidden, params=shared.value)
        own.ready()
        for batch in batches:
            held = batch.column(at).to_pylist()
            clean = [masked(t, s) for _, texts in slices(held) for t, (_, s) in zip(texts, all_spans(own, texts), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array([None if t is None else c for t, c in zip(held, clean, strict=True)], batch.schema.field(at).type))

    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the names are
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind are those of the base spans; n_added: spans of the network, n_secret: secrets among them."""
    docs = common.table(spark, sf_dir, "documents")
    found = detect(docs, fit(docs))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
    )
