"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are
lower-cased first.  A word is carried as a 64-bit hash of its bytes, so the code
below never builds Python strings.  A null text has no words.  Texts are handled
in slices of a few megabytes, so memory does not follow the batch size (one text
longer than a slice is a slice of its own).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_powers = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64)).astype(np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash's base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.full(size, 0xD6E8FEB86659FD93, np.uint64)).astype(np.uint64)
    return _powers


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    total = np.add.reduceat(_BYTE[buf[at]] * powers(int(lens.max()))[pos], first)
    return mix(total + lens.astype(np.uint64) * _STEP)


@dataclass
class Words:
    buf: np.ndarray      #: bytes of the slice's texts, A-Z lower-cased
    start: np.ndarray    #: first byte of each word
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray      #: row of each word, from 0 in the slice
    first: np.ndarray    #: rows + 1: number of words before each row


def text_slices(column, max_bytes: int = SLICE_BYTES):
    """Yields (first row, past row, bytes, offsets) over an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's end."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def split_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    buf = LOWER[raw]
    start, end = runs(~SPACE[buf], offsets)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buf, start, end, run_hashes(buf, start, end), doc, first)


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, sorted by row.  The sort key holds the row
    and the value's high bits; neighbours are then compared whole."""
    if not len(row):
        return row, value
    order = np.argsort(pair_key(row, value))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def pair_key(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    bits = max(1, int(row.max()).bit_length())
    return (row.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words; a row with fewer words gives its whole
    sequence as one, a row without words gives none."""
    h, first = words.hash, words.first
    counts = np.diff(first)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = h.copy()
    for j in range(1, k):
        grams[:-j] = mix(grams[:-j] * _M1 + h[j:])
    grams = mix(grams + np.uint64(k))
    index = np.arange(len(h)) - np.repeat(first[:-1], counts)
    whole = np.repeat(counts, counts)
    ok = index + k <= whole
    row, value = words.doc[ok], grams[ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for size in range(1, k):
            at = np.flatnonzero(counts[short] == size)
            g = h[first[short[at]]].copy()
            for j in range(1, size):
                g = mix(g * _M1 + h[first[short[at]] + j])
            extra[at] = mix(g + np.uint64(size))
        row, value = np.concatenate([row, short]), np.concatenate([value, extra])
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    return row, value
