"""Sliding order statistics of sorted window partitions.

Window stages leave the rows of a card (or of one of its time chunks) together and in time
order.  ``add_frame_statistics`` reads them in that order, a piece of rows after the other, and adds
what window aggregates could only compute by keeping and sorting every frame: means,
medians and deviations of the values, medians of the gaps, rows per calendar day.  Frame
bounds are positions: a row's frame of k days is the ``__n{k}`` rows (a window count)
before the first row of its own time.

A task holds a piece of rows and, of the rows before it, times, gaps and values of those that later frames
reach (25 to 35 bytes a row; the ``train`` profile also the gaps of the group so far).  Frames wider
than ``LIMIT`` rows are not ordered: see ``kth_of_ranges``.  Rows that are in a chunk as context only get zeros.
Values that are NULL take no part; the statistics of an empty frame are 0, as are those of a
row without a time.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fraudframe.functions import ranges
from fraudframe.functions.ranges import kth_of_ranges, midpoint, moments_of_ranges

#: Rows worked on together.
ROWS = 1 << 16


def pieces(batches, rows: int):
    """Tables of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, len(batch), rows):
            held.append(batch.slice(lo, rows))
            size += len(held[-1])
            if size >= rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _numpy(table: pa.Table, name: str, fill=0) -> np.ndarray:
    return table.column(name).fill_null(fill).to_numpy()


class Frames:
    """The rows that frames can reach, as pieces of a task's rows come in.  Positions count from the first held row."""

    def __init__(self, profile: str, intervals, limit: int | None = None):
        self.profile, self.intervals, self.limit = profile, intervals, limit or ranges.LIMIT
        self.names = ["us", "gap", "value", "keep"] + (["day", "first"] if profile == "serve" else [])
        self.held = None
        self.group = self.end = 0       # of the last row
        self.timed_before, self.us_before = True, None
        self.prefix = _Prefix() if profile == "train" else None

    def take(self, table: pa.Table) -> dict[str, np.ndarray]:
        """The statistics of the next rows."""
        self.table, n = table, len(table)
        before = 0 if self.held is None else len(self.held["us"])
        self.at = at = before + np.arange(n)
        self.first = first = table.column("__first").to_numpy().astype(bool)
        us, timed = _numpy(table, "__lb_us"), table.column("__lb_us").is_valid().to_numpy()
        gap = _numpy(table, "__gp", -1)
        self.slices = table.column("__lb_sn").is_valid().to_numpy() if "__lb_sn" in table.column_names else np.zeros(n, bool)
        self.context = _numpy(table, "__lb_ctx", False).astype(bool) if "__lb_ctx" in table.column_names else np.zeros(n, bool)
        keep = table.column("__lb_v").is_valid().to_numpy()
        if self.profile == "train":
            keep = keep & (gap != 0) & ~self.slices
        new = {"us": us, "gap": gap, "value": table.column("__lb_v").cast(pa.float64()).fill_null(0.0).to_numpy(), "keep": keep}
        if self.profile == "serve":
            new |= {"day": _numpy(table, "__day"), "first": first}
        self.held = new if self.held is None else {c: np.concatenate([self.held[c], new[c]]) for c in self.names}
        self.timed = timed
        self.groups = np.maximum.accumulate(np.where(first, at, self.group))
        same = np.r_[self.us_before is not None and us[0] == self.us_before and timed[0] == self.timed_before, (us[1:] == us[:-1]) & (timed[1:] == timed[:-1])]
        self.ends = np.maximum.accumulate(np.where(first | ~same, at, self.end))      # frames end before the first row of this time
        starts = {k: self.ends - np.where(timed, _numpy(table, f"__n{k}"), 0) for k in self.intervals}
        wanted = np.flatnonzero(~self.context & ~self.slices)
        out = {name: np.zeros(n, np.int64 if name.startswith(("__lo", "__hi")) else np.float64) for name in statistic_names(self.profile, self.intervals)}
        if len(wanted):
            for name, values in STATISTICS[self.profile](self, wanted, {k: s[wanted] for k, s in starts.items()}, self.ends[wanted]).items():
                out[name][wanted] = values
        if self.prefix is not None:
            out["__medgap"] = self.prefix.take(self, gap)
        # rows before all later frames are let go
        gone = int(min(s[-1] for s in starts.values()))
        self.held = {c: v[gone:].copy() for c, v in self.held.items()} if gone else self.held
        self.group, self.end = max(int(self.groups[-1]) - gone, -1), int(self.ends[-1]) - gone
        self.us_before, self.timed_before = us[-1], timed[-1]
        return out

    def medians(self, values, lo, hi) -> np.ndarray:
        n = hi - lo
        return np.where(n > 0, midpoint(*kth_of_ranges(values, lo, hi, [(n - 1) // 2, n // 2], self.limit)), 0.0)

    def medians_with(self, values, lo, hi, extra) -> np.ndarray:
        """Midpoint medians of each range and one value more."""
        n = hi - lo
        last = np.maximum(n - 1, 0)
        ranks = [n // 2, (n + 1) // 2]
        found = kth_of_ranges(values, lo, hi, [k for j in ranks for k in (np.maximum(j - 1, 0), np.minimum(j, last))], self.limit)

        def at(j, below, above):      # j-th smallest with the extra value: held between two neighbours
            return np.where(n == 0, extra, np.where(j == 0, np.minimum(extra, above), np.where(j >= n, np.maximum(below, extra), np.clip(
                extra, np.where(j > 0, below, extra), np.where(j < n, above, extra)))))

        return midpoint(at(ranks[0], found[0], found[1]), at(ranks[1], found[2], found[3]))

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the rows whose value takes part, for every row and the end, and their values."""
        keep = self.held["keep"]
        return np.r_[0, np.cumsum(keep)], self.held["value"][keep]


def _mean_median_deviation(f: Frames, out: dict, k: int, at, values, lo, hi) -> None:
    lo, hi = at[lo], at[hi]
    mean, m2 = moments_of_ranges(values, lo, hi, f.limit)
    out[f"__avg{k}"], out[f"__med{k}"] = mean, f.medians(values, lo, hi)
    out[f"__dev{k}"] = np.where(hi - lo > 1, np.sqrt(m2 / np.maximum(hi - lo - 1, 1)), 0.0)


def canonical_statistics(f: Frames, rows, starts, hi) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    kept = f.kept()
    for k in f.intervals:
        lo = starts[k]
        _mean_median_deviation(f, out, k, *kept, lo, hi)
        # the gap of a frame's first row leads out of the frame
        out[f"__medgap{k}"] = f.medians(f.held["gap"], np.minimum(lo + 1, hi), hi)
        out[f"__lo{k}"] = np.where(hi > lo, f.held["us"][lo], 0)
    return out


def serve_statistics(f: Frames, rows, starts, hi) -> dict[str, np.ndarray]:
    """The frames' rows together with the current row."""
    out: dict[str, np.ndarray] = {}
    at, values = f.kept()
    us, day = f.held["us"], f.held["day"]
    own_us, own_value = us[f.at[rows]], f.held["value"][f.at[rows]]
    new = np.r_[True, day[1:] != day[:-1]] | f.held["first"]
    run = (np.cumsum(new) - 1)[f.at[rows]]
    begins = np.flatnonzero(new)
    ends = np.r_[begins[1:], len(day)]
    for k in f.intervals:
        lo = starts[k]
        a, b = at[lo], at[hi]
        n = (b - a).astype(np.float64)
        mean, m2 = moments_of_ranges(values, a, b, f.limit)
        own = mean + (own_value - mean) / (n + 1)
        m2 = m2 + (own_value - mean) * (own_value - own)
        out[f"__avg{k}"], out[f"__med{k}"] = own, f.medians_with(values, a, b, own_value)
        out[f"__dev{k}"] = np.where(n > 0, np.sqrt(np.maximum(m2, 0.0) / np.maximum(n, 1)), 0.0)
        last = us[np.maximum(hi - 1, 0)]
        out[f"__medgap{k}"] = f.medians_with(f.held["gap"], np.minimum(lo + 1, hi), hi, own_us - last)
        out[f"__lo{k}"], out[f"__hi{k}"] = us[lo], last
        out[f"__mednr{k}"] = median_of_days(lo, hi, run, begins, ends, k)
    return out


def median_of_days(lo, hi, run, begins, ends, k: int) -> np.ndarray:
    """Median rows per calendar day that has any, the current row counted on its own day."""
    counts = np.zeros((len(lo), k + 2))
    for back in range(k + 2):
        r = np.maximum(run - back, 0)
        in_frame = np.minimum(hi, ends[r]) - np.maximum(lo, begins[r])
        counts[:, back] = np.where(run >= back, np.maximum(in_frame, 0), 0)
    counts[:, 0] += 1
    counts.sort(1)
    days = (counts > 0).sum(1)
    at = np.arange(len(lo))
    first = counts.shape[1] - days
    return midpoint(counts[at, first + (days - 1) // 2], counts[at, first + days // 2])


def train_statistics(f: Frames, rows, starts, hi) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    kept = f.kept()
    for k in f.intervals:
        _mean_median_deviation(f, out, k, *kept, starts[k], hi)
    return out


class _Prefix:
    """Median of all earlier gaps of the card.

    A chunk of a split card starts with the values of earlier chunks at the ranks its
    medians can fall on; ``__lb_below`` values are smaller, ``__lb_gaps`` there are in all."""

    def __init__(self):
        self.values = np.zeros(0, np.int64)     # of the group so far: slices, then own gaps
        self.owned = self.below = self.before = 0
        self.tie = self.tie_owned = 0           # how many before the first row of the last time

    def take(self, f: Frames, gap: np.ndarray) -> np.ndarray:
        table, slices, n = f.table, f.slices, len(gap)
        own = (gap >= 0) & ~slices & ~f.context
        times, value = own.astype(np.int64), gap
        below, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if slices.any():
            times, value = np.where(slices, _numpy(table, "__lb_sn"), times), np.where(slices, _numpy(table, "__lb_sv"), gap)
            below, before = _numpy(table, "__lb_below"), _numpy(table, "__lb_gaps")
        values = np.concatenate([self.values, np.repeat(value, times)])
        # positions among all of them; those of the rows held from before are kept as numbers
        at = len(self.values) + np.r_[0, np.cumsum(times)]
        owned = self.owned + np.r_[0, np.cumsum(own)]
        here = int(f.at[0])
        group, end = f.groups - here, f.ends - here
        old, g, e = group < 0, np.maximum(group, 0), np.maximum(end, 0)
        lo, owned_lo = np.where(old, 0, at[g]), np.where(old, 0, owned[g])
        below, before = np.where(old, self.below, below[g]), np.where(old, self.before, before[g])
        hi, owned_hi = np.where(end < 0, self.tie, at[e]), np.where(end < 0, self.tie_owned, owned[e])
        m = before + owned_hi - owned_lo
        ok = np.flatnonzero((m > 0) & f.timed & ~f.context & ~slices)
        out = np.zeros(n)
        k = m[ok]
        out[ok] = midpoint(*kth_of_ranges(values, lo[ok], hi[ok], [(k - 1) // 2 - below[ok], k // 2 - below[ok]], f.limit))
        self.values, self.owned = values[lo[-1]:].copy(), int(owned[-1] - owned_lo[-1])
        self.tie, self.tie_owned = int(hi[-1] - lo[-1]), int(owned_hi[-1] - owned_lo[-1])
        self.below, self.before = int(below[-1]), int(before[-1])
        return out


STATISTICS = {"canonical": canonical_statistics, "serve": serve_statistics, "train": train_statistics}


def statistic_names(profile: str, intervals) -> list[str]:
    per = {"canonical": ["avg", "med", "dev", "medgap", "lo"], "serve": ["avg", "med", "dev", "medgap", "lo", "hi", "mednr"],
           "train": ["avg", "med", "dev"]}[profile]
    return [f"__{name}{k}" for k in intervals for name in per] + (["__medgap"] if profile == "train" else [])


def add_frame_statistics(df: DataFrame, profile: str, intervals) -> DataFrame:
    """df, whose partitions hold whole groups in time order, with the profile's statistics."""
    names, rows, limit = statistic_names(profile, intervals), ROWS, ranges.LIMIT
    kinds = [T.LongType() if n.startswith(("__lo", "__hi")) else T.DoubleType() for n in names]
    schema = T.StructType(df.schema.fields + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches):
        frames = Frames(profile, intervals, limit)
        for table in pieces(batches, rows):
            found = frames.take(table)
            for n in names:
                table = table.append_column(n, pa.array(found[n]))
            yield from table.to_batches(max_chunksize=ROWS)

    return df.mapInArrow(run, schema)
