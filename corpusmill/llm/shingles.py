"""Word shingles of whole batches of texts in numpy, straight from Arrow buffers.

Defined results: null, empty and blank texts have none; a text of fewer words
than a shingle has one, the whole sequence; very long texts are taken whole,
at some 60 bytes of memory for each of theirs; the rest of a batch does not
change a text's set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once, or one text if it is longer: some 60 bytes of memory for each.
SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACES = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        _powers[:] = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1][:n]


def _sets(data: np.ndarray, offset: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """data: UTF-8 of the texts in a row; offset: where each begins, and the end."""
    n = len(data)
    if not n:
        yield from (np.zeros(0, np.uint64) for _ in offset[1:])
        return
    data = _LOWER[data]
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offset] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power, out=total[1:])
    word = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    first, last = np.searchsorted(start, offset[:-1]), np.searchsorted(start, offset[1:])
    gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        gram += word[k : k + len(gram)] * _PLACES[k]
    gram = mix(gram)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            yield np.unique(gram[a : b - words + 1])
        elif b > a:  # the whole sequence is the only shingle
            h = (word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text (null: none) its distinct shingles, sorted 64-bit hashes. A to Z count as lower case."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offset = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        j = max(k + 1, int(np.searchsorted(offset, offset[k] + SLICE_BYTES, "right")) - 1)
        yield from _sets(data[offset[k] : offset[j]], offset[k : j + 1] - offset[k], words)
        k = j
