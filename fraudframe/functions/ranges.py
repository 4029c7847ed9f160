"""Order statistics and moments of many index ranges of one numpy array.

Both helpers answer all ranges together, level by level, so n ranges over n values cost
n log n array operations however wide the ranges are, and no range is copied or sorted.
"""
from __future__ import annotations

import numpy as np


class RangeOrder:
    """k-th smallest value of any range: the ranks' bits, each with the counts of zeros.

    On every level the values are parted by one bit of their rank, zeros first, keeping
    their order; a range stays a range in either part, and the count of zeros in it tells
    in which part its k-th smallest lies.
    """

    def __init__(self, values: np.ndarray):
        self.sorted, codes = np.unique(values, return_inverse=True)
        codes = codes.astype(np.int32)
        self.levels = []
        for bit in range(max(1, (len(self.sorted) - 1).bit_length()) - 1, -1, -1):
            one = ((codes >> bit) & 1).astype(bool)
            zeros = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            codes = np.concatenate([codes[~one], codes[one]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The values at rank k, from 0, of the ranges [lo, hi); k outside a range gives any value."""
        if not len(self.sorted):
            return np.zeros(len(lo), self.sorted.dtype)
        lo, hi, k = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64)
        rank = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            right = k >= b - a
            k = np.where(right, k - (b - a), k)
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
            rank |= right.astype(np.int64) << bit
        return self.sorted[np.minimum(rank, len(self.sorted) - 1)]

    def median(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Midpoint medians, 0 for empty ranges."""
        n = hi - lo
        ok = n > 0
        out = np.zeros(len(lo))
        lo, hi, n = lo[ok], hi[ok], n[ok]
        out[ok] = midpoint(self.kth(lo, hi, (n - 1) // 2), self.kth(lo, hi, n // 2))
        return out

    def median_with(self, lo: np.ndarray, hi: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Midpoint medians of each range and one value more."""
        n = hi - lo

        def at(j: np.ndarray) -> np.ndarray:      # j-th smallest with the extra value: held between two neighbours
            below = np.where(j > 0, self.kth(lo, hi, np.maximum(j - 1, 0)), extra)
            above = np.where(j < n, self.kth(lo, hi, np.minimum(j, np.maximum(n - 1, 0))), extra)
            return np.where(n == 0, extra, np.where(j == 0, np.minimum(extra, above), np.where(j >= n, np.maximum(below, extra),
                                                                                               np.clip(extra, below, above))))

        return midpoint(at(n // 2), at((n + 1) // 2))


def midpoint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.float64) + b.astype(np.float64)) / 2


def range_moments(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of each range, 0 for empty ranges.

    A range is the union of blocks of 1, 2, 4, ... values; blocks and answers are merged
    pairwise, so no large sums are subtracted from one another.
    """
    total, at = hi - lo, lo.copy()
    mean, m2, n = np.zeros(len(lo)), np.zeros(len(lo)), np.zeros(len(lo))
    block, square, size = values.astype(np.float64), np.zeros(len(values)), 1
    with np.errstate(invalid="ignore", over="ignore"):
        while len(total) and size <= total.max():
            use = np.flatnonzero(total & size)
            b, s = block[at[use]], square[at[use]]
            delta, both = b - mean[use], n[use] + size
            mean[use] += delta * size / both
            m2[use] += s + delta * delta * n[use] * size / both
            n[use] = both
            at[use] += size
            if len(block) > size:
                delta = block[size:] - block[:-size]
                block, square = block[:-size] + delta / 2, square[:-size] + square[size:] + delta * delta * (size / 2)
            size *= 2
    return mean, m2


#: Values that are ordered together where ranges are wide.
LIMIT = 1 << 18


def _pieces(lo: np.ndarray, hi: np.ndarray, limit: int):
    """(first query, last, inner, outer) of runs of neighbouring, non-empty ranges: all values of a run are at
    most ``limit`` (inner is None), or the ranges share the values inner to outer and few others."""
    todo = [(0, len(lo))] if len(lo) else []
    while todo:
        a, b = todo.pop()
        least, inner, outer, most = lo[a:b].min(), lo[a:b].max(), hi[a:b].min(), hi[a:b].max()
        if most - least <= limit:
            yield a, b, least, None, None, most
        elif inner < outer and (inner - least) + (most - outer) <= limit:
            yield a, b, least, inner, outer, most
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]


def kth_of_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, ks: list[np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    """The values at ranks ``ks`` (from 0) of the ranges [lo, hi), 0 for empty ones.

    What neighbouring wide ranges share is not ordered: of it only the ranks can matter that the few
    other values leave open, and a partition finds these."""
    found = [np.zeros(len(lo), values.dtype) for _ in ks]
    ok = np.flatnonzero(hi > lo)
    lo, hi, wanted = lo[ok], hi[ok], [k[ok] for k in ks]
    for a, b, least, inner, outer, most in _pieces(lo, hi, limit):
        part, begin, end, skip = values[least:most], lo[a:b] - least, hi[a:b] - least, 0
        if inner is not None:
            edge, n = int(inner - least + most - outer), int(outer - inner)
            skip = min(n, max(0, int(min(k[a:b].min() for k in wanted)) - edge))
            last = min(n - 1, max(skip, int(max(k[a:b].max() for k in wanted))))
            core = np.partition(values[inner:outer], sorted({min(skip, n - 1), last}))[skip:last + 1]
            part = np.concatenate([values[least:inner], core, values[outer:most]])
            end = hi[a:b] - outer + (inner - least) + len(core)
        order = RangeOrder(part)
        for out, k in zip(found, wanted):
            out[ok[a:b]] = order.kth(begin, end, k[a:b] - skip)
    return found


def moments_of_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """``range_moments``; what neighbouring wide ranges share is summed once."""
    mean, m2 = np.zeros(len(lo)), np.zeros(len(lo))
    ok = np.flatnonzero(hi > lo)
    lo, hi = lo[ok], hi[ok]
    with np.errstate(invalid="ignore", over="ignore"):
        for a, b, least, inner, outer, most in _pieces(lo, hi, limit):
            if inner is None:
                mean[ok[a:b]], m2[ok[a:b]] = range_moments(values[least:most], lo[a:b] - least, hi[a:b] - least)
                continue
            core = values[inner:outer].astype(np.float64)
            n, own = np.full(b - a, float(outer - inner)), np.full(b - a, core.mean())
            square = np.full(b - a, ((core - own[0]) ** 2).sum())
            for piece, begin, end in ((values[least:inner], lo[a:b] - least, np.full(b - a, inner - least)),
                                      (values[outer:most], np.zeros(b - a, np.int64), hi[a:b] - outer)):
                more, (their, theirs) = end - begin, range_moments(piece, begin, end)
                delta, both = np.where(more > 0, their - own, 0.0), n + more
                own = own + delta * more / both
                square, n = square + theirs + delta * delta * n * more / both, both
            mean[ok[a:b]], m2[ok[a:b]] = own, square
    return mean, m2
