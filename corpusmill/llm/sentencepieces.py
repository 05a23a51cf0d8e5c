"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words at the marker of a blank. All distinct words of a
batch lie in one flat symbol array; a round finds the smallest pair rank of
each word, merges its occurrences from the left in every word at once, compacts
the array, and drops words in which no pair is left. Where a merge would give
rise to a pair of the same or a smaller rank, which the library's agenda would
take before the word's next occurrence, only the leftmost is merged, so results
are the same piece by piece.

Defined results
* null text: the empty text, of which only the end id remains
* very long texts and words: whole; words of over LONG_WORD symbols go through
  rounds of their own, so that short ones need not wait for them
* characters outside the vocabulary: their UTF-8 bytes as byte pieces
* repeated rows, null ids, empty tables: row by row, as they come
* extra or clashing columns: not looked at
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

SPACE = "▁"
#: Symbols beyond which a word has rounds of its own.
LONG_WORD = 256
#: Words, and bytes of what they come to, that a worker remembers; the memory starts anew beyond that.
CACHE_WORDS = 300_000
CACHE_BYTES = 128 << 20
_NEVER = np.int32(2**31 - 1)


class Bpe:
    """A piece vocabulary with its pair table."""

    def __init__(self, model_file: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.eos = lib.eos_id()
        self.byte_ids = np.zeros(256, np.int32)
        self.text = [b""] * n
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.text[i] = bytes([b])
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                pieces[piece] = i
                self.text[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on behind a blank: words can't be merged one by one")
        self.symbols = dict(pieces)
        self.n = n
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols))
        scores = np.array([lib.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.rank = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.decimal = [str(i) for i in range(n)]
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        piece = np.where(hit, self.merged[at], 0)
        return np.where(hit, self.rank[piece], _NEVER), piece

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges of many words at once: which word, its number of symbols, and all symbols, in the order in which words were done."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        own = np.arange(len(words))
        rank = np.full(len(sym), _NEVER, np.int32)
        piece = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], piece[:-1] = self._look_up(sym[:-1], sym[1:])
        rank[np.cumsum(length) - 1] = _NEVER
        while len(own):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, start)
            over = best == _NEVER
            if over.any():
                stay = np.repeat(~over, length)
                done.append((own[over], length[over], sym[~stay]))
                sym, rank, piece = sym[stay], rank[stay], piece[stay]
                own, length, best = own[~over], length[~over], best[~over]
                if not len(own):
                    break
            word = np.repeat(np.arange(len(own)), length)
            at = np.flatnonzero(rank == best[word])
            at = self._merged_at_once(at, word, best, sym, piece)
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, piece = sym[keep], rank[keep], piece[keep]
            length = length - np.bincount(word[at], minlength=len(own))
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched + 1 < len(sym)]
            rank[touched], piece[touched] = self._look_up(sym[touched], sym[touched + 1])
            rank[np.cumsum(length) - 1] = _NEVER
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))  # type: ignore[return-value]

    def _merged_at_once(self, at: np.ndarray, word: np.ndarray, best: np.ndarray, sym: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Of the places of the smallest rank in each word: those that are merged in this round."""
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        if first.all():
            return at
        # of places in a row every other one, as they share symbols
        begin = np.r_[True, at[1:] != at[:-1] + 1]
        run = np.flatnonzero(begin)
        at = at[(np.arange(len(at)) - run[np.cumsum(begin) - 1]) % 2 == 0]
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        own = word[at]
        if first.all():
            return at
        # what each merge would stand beside for a while: the symbol before, itself merged if it is one of these, and the one behind
        right = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[right] == own)
        after = np.where(has_right, self._look_up(piece[at].astype(np.int64), sym[right])[0], _NEVER)
        left = np.maximum(at - 1, 0)
        has_left = (at > 0) & (word[left] == own)
        joined = np.r_[False, at[1:] == at[:-1] + 2] & has_left
        beside = np.where(joined, piece[np.maximum(at - 2, 0)], sym[left])
        before = np.where(has_left, self._look_up(beside.astype(np.int64), piece[at])[0], _NEVER)
        early = np.zeros(len(best), bool)
        early[own[np.minimum(after, before) <= best[own]]] = True
        return at[first | ~early[own]]

    def _bytes_in(self, word: str, symbols: list[int]) -> list[int]:
        """Piece ids of symbols of which some are no piece: those become bytes."""
        chars = iter(c for c in word if not 0 <= self.symbols.get(c, -1) < self.n)
        out: list[int] = []
        for s in symbols:
            out += [s] if 0 <= s < self.n else self.byte_ids[list(next(chars).encode("utf-8", "replace"))].tolist()
        return out

    def segments(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def _keep(self, word: str, ids: list[int]) -> None:
        found = (" ".join([self.decimal[k] for k in ids]), len(ids), b"".join([self.text[k] for k in ids]))
        self.words[word] = found
        self.held += 4 * len(word) + len(found[0]) + len(found[2])

    def forget(self) -> None:
        """Empty the memory."""
        self.words = {}
        self.held = 0

    def learn(self, words: Iterable[str]) -> None:
        """Put words into the memory."""
        new = [w for w in words if w not in self.words]
        for part in ([w for w in new if len(w) <= LONG_WORD], *([w] for w in new if len(w) > LONG_WORD)):
            if not part:
                continue
            own, length, symbols = self._rounds(part)
            odd = (symbols < 0) | (symbols >= self.n)
            begin = np.cumsum(length) - length
            odd_word = np.logical_or.reduceat(odd, begin)
            flat = symbols.tolist()
            for k, a, n, x in zip(own.tolist(), begin.tolist(), length.tolist(), odd_word.tolist(), strict=True):
                ids = flat[a : a + n]
                self._keep(part[k], self._bytes_in(part[k], ids) if x else ids)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text the ids as decimal words, their number, and the decoded text in UTF-8; the end id is last."""
        for k in range(0, len(texts), 256):
            cut = [self.segments(t) for t in texts[k : k + 256]]
            if len(self.words) > CACHE_WORDS or self.held > CACHE_BYTES:
                self.forget()
            self.learn({w for c in cut for w in c})
            for c in cut:
                got = [self.words[w] for w in c]
                yield (
                    " ".join([*[x[0] for x in got], str(self.eos)]),
                    sum([x[1] for x in got]) + 1,
                    b"".join([x[2] for x in got])[1:],  # without the blank put before each text
                )

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a list of ids, as the library gives it for ids that encode() made."""
        text = b"".join([self.text[i] for i in ids])
        return text.removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(model_file: str) -> Bpe:
    """The vocabulary, loaded once in a worker."""
    if model_file not in _loaded:
        _loaded[model_file] = Bpe(model_file)
    return _loaded[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, with_ids: also the ids. The vocabulary file must be at the same path on every executor."""
    common.text_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    path = model_file or default_model()
    kind = source.schema["doc_id"].dataType.simpleString()

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [(n, ids if with_ids else None, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()) for ids, n, text in model.encode(texts)]
            n, ids, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([np.array(x.split(), np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        model.forget()  # the worker may do other work next

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
