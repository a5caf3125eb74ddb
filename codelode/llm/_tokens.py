"""Words of whole slabs of text and their hashes, in numpy.

A word is a run of bytes other than space and \\x09-\\x0D, which is the same as of characters, as UTF-8 keeps those bytes for
themselves. A word's hash is the sum of a pseudo-random value for each (place in the word, byte), mixed with its length; no
pattern of bytes makes such sums meet, unlike those of polynomials modulo a power of two. Windows of words have Rabin-Karp
hashes: polynomials in the words' hashes modulo the prime 2^61 - 1, by doubling (H of 2k words from two of k), so that two
different windows of n words meet with a chance of some n / 2^61.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME, _BASE = (1 << 61) - 1, 0x0D1342543DE82EF95 % ((1 << 61) - 1)
_P, _U1, _U30, _U31, _U61 = np.uint64(_PRIME), np.uint64(1), np.uint64(30), np.uint64(31), np.uint64(61)
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_PLACES = 64  # places in a word whose values are looked up; later ones are computed


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _value(code: np.ndarray, seed: int) -> np.ndarray:
    """The pseudo-random value of place * 256 + byte."""
    return mix((code.astype(np.uint64) + _U1) * _STEP ^ mix(np.array([seed + 1], np.uint64)))


@lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return _value(np.arange(_PLACES << 8), seed)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run data[start:end] of bytes; runs are in order, apart and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = (end - start).astype(np.int32)
    at = np.cumsum(size) - size  # where the runs start when nothing lies between them
    if len(data) != at[-1] + size[-1]:
        flag = np.zeros(len(data) + 1, np.int8)
        flag[start] = 1
        flag[end] -= 1
        data = data[np.cumsum(flag[:-1], dtype=np.int8).view(bool)]
    place = np.arange(len(data), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    value = _table(seed)[(np.minimum(place, _PLACES - 1) << 8) + data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] = _value((place[far].astype(np.int64) << 8) + data[far], seed)
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _M2)


def modmul(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2^61 - 1, for a and b below it."""
    bh, bl = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    ah, al = a >> _U31, a & _M31
    mid = al * bh + ah * bl
    return fold(((ah * bh) << _U1) + (mid >> _U30) + ((mid & _M30) << _U31) + al * bl)


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = (x & _P) + (x >> _U61)
    return x - _P * (x >= _P)


@dataclass
class Words:
    """Words of the texts of one slab: byte bounds, the text each is of, and how many each text has."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        return run_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end, seed)

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.count)])


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; null counts as empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(texts: pa.Array) -> Words:
    data, off = buffer(texts)
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, off, empty, empty, empty, np.zeros(len(off) - 1, np.int64))
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = True
    after[off[1:][full] - 1] = True
    solid = ~space
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return Words(data, off, start, end, doc, np.bincount(doc, minlength=len(off) - 1).astype(np.int64))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of size words that lies in one text."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = fold(hashes)
    h, length = one, 1
    for bit in bin(size)[3:]:
        h = fold(modmul(h[:-length], pow(_BASE, length, _PRIME)) + h[length:])
        length *= 2
        if bit == "1":
            h = fold(modmul(h[:-1], _BASE) + one[length:])
            length += 1
    at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    return at, mix(h[at])
