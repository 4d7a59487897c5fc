"""Vectorised text kernels over Arrow string arrays: words and their 64-bit hashes, without per-word Python.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words are found on the UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse mod 2**64
_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)  # odd as well
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
#: With this, words are runs of ASCII letters and digits and of any other characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
        if n > 8 * CHUNK_BYTES:  # a very long text: don't keep what it took
            return _powers.pop(base)
    return _powers[base][:n]


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (a longer text alone)."""
    sizes = np.diff(offsets(texts))
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def whole(texts: pa.Array) -> pa.Array:
    """Nulls as empty texts, in the 64-bit layout."""
    return texts.cast(pa.large_string()).fill_null("")


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


class Words:
    """The words of a piece: byte ranges in ``data``, their document's place and first word of each document."""

    def __init__(self, texts: pa.Array, separator: np.ndarray = _SEPARATOR):
        at = offsets(texts)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        inside = ~separator[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.at)  # of each document, and the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word's bytes: a polynomial of random byte values, as a difference of prefix sums."""
        data = self.data if data is None else data
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_MULTIPLIER, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(_INVERSE, n + 1)[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64))

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z lowered."""
        data = self.data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        return data


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k consecutive word hashes from each place, by prefix sums; there are len(h) - k + 1."""
    base = _BASES[seed]
    n = max(len(h) - k + 1, 0)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return mix((total[k : k + n] - total[:n]) * powers(pow(base, -1, 1 << 64), n))


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", separator: np.ndarray = _SEPARATOR) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Each batch in pieces of bounded size with their words."""
    for batch in batches:
        texts = whole(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in pieces(texts):
            yield batch.slice(lo, hi - lo), Words(texts.slice(lo, hi - lo), separator)


class Lookup:
    """From 64-bit hashes to places in a bounded list, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 2 - 1).bit_length() + 1)
        self.mask = (1 << bits) - 1
        self.key, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), (keys & _U(self.mask)).astype(np.int64)
        while len(left):
            free = self.place[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            win = left[free][first]
            self.key[slot], self.place[slot] = keys[win], win
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h & _U(self.mask)).astype(np.int64)
        out = np.where(self.key[at] == h, self.place[at], -1)
        todo = np.flatnonzero((out < 0) & (self.place[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            x = at[todo]
            hit = self.key[x] == h[todo]
            out[todo] = np.where(hit & (self.place[x] >= 0), self.place[x], -1)
            todo = todo[~hit & (self.place[x] >= 0)]
        return out
