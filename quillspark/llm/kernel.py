"""Vectorised text kernel: whole Arrow string columns at a time, no per-row Python.

A column is walked in chunks of about ``CHUNK`` bytes (never splitting a document), lower-cased
with a byte table (ASCII and the Latin-1 letters of UTF-8), cut into words (ASCII letters and
digits, and any other non-ASCII letter bytes; general punctuation separates) and every word gets
a 64-bit polynomial hash from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        p = np.full(size, _R, np.uint64)
        q = np.full(size, _RINV, np.uint64)
        p[0] = q[0] = 1
        if size > CHUNK * 8:  # one very long text: don't keep its tables
            return np.multiply.accumulate(p), np.multiply.accumulate(q)
        _pow, _inv = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """One chunk. ``lo``: index of its first document in the column; ``raw`` and ``low``: its
    bytes; ``at``: byte offsets of its documents (n + 1); ``start``, ``end``: byte spans of words;
    ``doc``: index within the chunk of each word's document; ``first``: word offsets (n + 1)."""

    lo: int
    raw: np.ndarray
    low: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off.astype(np.int64)


def raw_chunks(arr: pa.Array, target: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, byte offsets) of runs of whole documents of about ``target`` bytes."""
    data, off = column(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + target, "right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower(raw: np.ndarray) -> np.ndarray:
    low = _LOWER[raw]
    if len(raw) > 1:
        hit = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        if hit.any():
            low[1:][hit] += 32
    return low


def word_mask(raw: np.ndarray) -> np.ndarray:
    is_word = _WORD[raw]
    if len(raw) > 1:
        two = raw[:-1] == 0xC2  # Latin-1 signs and the no-break space
        if two.any():
            is_word[:-1][two] = False
            is_word[1:][two] = False
        three = (raw[:-1] == 0xE2) & ((raw[1:] == 0x80) | (raw[1:] == 0x81))
        if three.any():
            p = np.flatnonzero(three)
            is_word[p] = is_word[p + 1] = False
            is_word[np.minimum(p + 2, len(raw) - 1)] = False
    return is_word


def span_hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(low) + 1)
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def words(arr: pa.Array, target: int = CHUNK, hashed: bool = True) -> Iterator[Words]:
    for lo, raw, at in raw_chunks(arr, target):
        low = lower(raw)
        is_word = word_mask(raw)
        n = len(raw)
        begins = np.zeros(n + 1, bool)
        begins[at[:-1]] = True
        begins = begins[:n]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = is_word[:-1]
        start = np.flatnonzero(is_word & (~before | begins))
        after = np.zeros(n, bool)
        if n:
            after[:-1] = is_word[1:] & ~begins[1:]
        end = np.flatnonzero(is_word & ~after) + 1
        doc = np.searchsorted(at, start, "right") - 1
        first = np.searchsorted(start, at, "left")
        yield Words(lo, raw, low, at, start, end, doc, first, span_hash(low, start, end) if hashed else np.zeros(0, np.uint64))


def hash_words(texts: list[str]) -> np.ndarray:
    """Hash of each given single word, as ``words`` would give it."""
    out = np.zeros(len(texts), np.uint64)
    for w in words(pa.array(texts, pa.string())):
        for d in range(w.n):
            if w.first[d + 1] > w.first[d]:
                out[w.lo + d] = w.hash[w.first[d]]
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, empty runs give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def counts(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of true flags between consecutive offsets."""
    p = np.flatnonzero(flags)
    return np.searchsorted(p, first[1:]) - np.searchsorted(p, first[:-1])


def member(hashes: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Index into ``sorted_set`` of each hash, -1 where absent."""
    if not len(sorted_set) or not len(hashes):
        return np.full(len(hashes), -1, np.int64)
    bits = np.zeros(1 << 20, bool)  # most are dropped by one look at a small table
    bits[sorted_set >> np.uint64(44)] = True
    out = np.full(len(hashes), -1, np.int64)
    p = np.flatnonzero(bits[hashes >> np.uint64(44)])
    if len(p):
        k = np.minimum(np.searchsorted(sorted_set, hashes[p]), len(sorted_set) - 1)
        good = sorted_set[k] == hashes[p]
        out[p[good]] = k[good]
    return out
