"""Range medians and moments against numpy, range by range."""
import numpy as np
import pytest

from fraudframe.functions.ranges import RangeOrder, range_moments


@pytest.mark.parametrize("n", [1, 2, 5, 300])
@pytest.mark.parametrize("kind", ["normal", "ties", "whole", "large"])
def test_ranges(n, kind):
    rng = np.random.default_rng(n)
    make = {"normal": lambda: rng.normal(size=n), "ties": lambda: rng.integers(0, 4, n).astype(float), "whole": lambda: rng.integers(0, 9, n),
            "large": lambda: 1e9 + rng.normal(size=n)}[kind]
    v, extra = make(), make()[rng.integers(0, n, 400)]
    a, b = rng.integers(0, n + 1, 400), rng.integers(0, n + 1, 400)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = RangeOrder(v)
    median, with_extra = order.median(lo, hi), order.median_with(lo, hi, extra)
    mean, m2 = range_moments(v, lo, hi)
    for i, (x, y) in enumerate(zip(lo, hi)):
        part = v[x:y]
        assert with_extra[i] == np.median(np.append(part, extra[i]))
        assert median[i] == (np.median(part) if len(part) else 0)
        for k in range(0, len(part), max(1, len(part) // 5)):
            assert order.kth(lo[i:i + 1], hi[i:i + 1], np.array([k]))[0] == np.sort(part)[k]
        if len(part):
            assert mean[i] == pytest.approx(part.mean(), rel=1e-14) and m2[i] == pytest.approx(((part - part.mean()) ** 2).sum(), rel=1e-6, abs=1e-12)
        else:
            assert mean[i] == m2[i] == 0


def test_nothing():
    none = np.zeros(0, np.int64)
    order = RangeOrder(np.zeros(0))
    assert len(order.median(none, none)) == 0 and order.median(np.zeros(2, int), np.zeros(2, int)).tolist() == [0, 0]
    assert len(range_moments(np.zeros(0), none, none)[0]) == 0


def test_wide_ranges_by_what_they_share():
    from fraudframe.functions.ranges import kth_of_ranges, moments_of_ranges
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=4000), 2)
    lo = np.sort(rng.integers(0, 1500, 300))
    hi = np.maximum(np.sort(rng.integers(0, 4001, 300)), lo)
    hi[100:120] = lo[100:120]
    n = hi - lo
    for limit in (16, 300, 1 << 18):
        a, b = kth_of_ranges(x, lo, hi, [(n - 1) // 2, n // 2], limit)
        mean, m2 = moments_of_ranges(x, lo, hi, limit)
        for i in np.flatnonzero(n > 0):
            own = x[lo[i]:hi[i]]
            assert (a[i] + b[i]) / 2 == np.median(own)
            assert abs(mean[i] - own.mean()) < 1e-12 and abs(m2[i] - ((own - own.mean()) ** 2).sum()) < 1e-8
        assert not mean[100:120].any() and not a[100:120].any()


@pytest.mark.parametrize("profile", ["canonical", "serve", "train"])
def test_frames_hold_what_later_rows_reach(profile):
    """A long card in pieces: the same statistics as in one piece, and only one frame of rows is held."""
    import pyarrow as pa

    from fraudframe.operators.frames import Frames
    rng = np.random.default_rng(6)
    day, n = 86_400_000_000, 6000
    us = np.sort(rng.integers(0, 120 * day, n) // 3_600_000_000 * 3_600_000_000)
    us[n // 3:2 * n // 3] = np.sort(us[n // 3:2 * n // 3] % (40 * day))
    first = np.isin(np.arange(n), [0, n // 3, 2 * n // 3])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    counts = {k: np.zeros(n, np.int64) for k in (3, 7)}
    for i in range(n):
        own = us[group[i]:i + 1]
        for k in counts:
            counts[k][i] = ((own < us[i]) & (own > us[i] - k * day)).sum()
    gap = np.where(first, -1, np.r_[0, np.diff(us)])
    value = pa.array(np.round(rng.normal(size=n), 1), mask=rng.random(n) < 0.1)
    table = pa.table({"__first": first, "__lb_us": us, "__gp": gap, "__lb_v": value, "__day": (us + day // 2) // day, **{f"__n{k}": c for k, c in counts.items()}})
    whole = Frames(profile, (3, 7)).take(table)
    frames, parts = Frames(profile, (3, 7), 64), []
    for lo in range(0, n, 97):
        parts.append(frames.take(table.slice(lo, 97)))
        assert len(frames.held["us"]) <= counts[7].max() + 97 + 24
    for name, values in whole.items():
        some = counts[int(name[-1])] > 0 if name[-1] in "37" else np.ones(n, bool)      # of no meaning without a frame
        assert np.allclose(np.concatenate([p[name] for p in parts])[some], values[some], rtol=1e-9, atol=1e-9), name
