"""Hashes of words, lines and shingles over batches of texts, in numpy.

Texts are joined by line feeds, which bound words and lines alike, so that one pass of
array operations serves a batch. A span is hashed by differences of running sums of
``value * B**position`` modulo 2**64, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd base and its inverse modulo 2**64, and the constants of the mixer.
BASE = 0x9E6C63D0876A9A35
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
GOLDEN = 0x9E3779B97F4A7C15

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
# Bytes worked on at once; a single text may be longer.
SLICE = 2_000_000
_STRETCH = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, _STRETCH + 1)
        table = np.full(size, base, U64)
        table[0] = 1
        _powers[base] = np.cumprod(table, dtype=U64)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(MIX_1)
    x = (x ^ (x >> U64(27))) * U64(MIX_2)
    return x ^ (x >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for sorted spans, a stretch of values at a time."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _STRETCH, "right")))
        n = int(ends[j - 1] - low)
        part = values[low : low + n].astype(U64)
        part += U64(1)
        part *= _power(BASE, n)[:n]
        sums = np.zeros(n + 1, U64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        size = (e - s).astype(U64)
        out[i:j] = (sums[e] - sums[s]) * _power(INVERSE, n + 1)[s] + size * U64(GOLDEN)
        i = j
    return mix(out)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as bytes, a few at a time, each with the number of its first row."""
    texts = batch.column(column).cast(pa.binary())
    size, first, part = 0, 0, []
    for i, text in enumerate(texts):
        text = text.as_py() or b""
        part.append(text)
        size += len(text)
        if size >= SLICE:
            yield first, part
            size, first, part = 0, i + 1, []
    if part:
        yield first, part


class Words:
    """The words of some texts: their hashes, and the bounds of each text among them."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        folded = np.frombuffer(joined.translate(FOLD), np.uint8) if fold else self.raw
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.space = _SPACE[self.raw]
        edge = np.diff(self.space, prepend=np.int8(1), append=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hashes = span_hashes(folded, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def owners(self, positions: np.ndarray) -> np.ndarray:
        """The number of the text in which each byte position lies."""
        return np.searchsorted(self.offsets, positions, "right") - 1


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` neighbours."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.zeros(n, U64)
    for i in range(k):
        total += hashes[i : i + n] * U64(pow(BASE, i + 1, 1 << 64))
    return mix(total)


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``k``-word shingles.

    Fewer words than ``k`` are one shingle; no word, none.
    """
    every = windows(words.hashes, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= k:
            found = np.sort(every[a : b - k + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif b > a:
            out.append(windows(words.hashes[a:b], b - a) + U64(b - a))
        else:
            out.append(np.empty(0, U64))
    return out
