"""Plain-Python restatement of the look-back feature table (README,
"Look-back features"), row by row, for checking the Spark operator."""
from __future__ import annotations

import statistics

import numpy as np

D = 86_400_000_000


def _mean(xs):
    return statistics.mean(xs) if xs else 0.0


def _median(xs):
    return statistics.median(xs) if xs else 0.0


def _stdev(xs):
    return statistics.stdev(xs) if len(xs) >= 2 else 0.0


def _div(a, b):
    return a / b if b != 0 else 0.0


def _counts(t, prior_us, k):
    n = 1 + sum(1 for u in prior_us if u > t - D)
    buckets = [sum(1 for u in prior_us if t - (i + 1) * D < u < t - i * D) for i in range(k)]
    a, m = _mean(buckets), _median(buckets)
    return [_div(n, a), n - a, _div(n, m), n - m]


def _gapf(avg_gap, med_gap, g):
    return [_div(avg_gap, g), avg_gap - g, _div(med_gap, g), med_gap - g]


def canonical(rows, intervals):
    """rows: list of (id, us, v) of ONE entity -> {id: [features]}"""
    out = {}
    for rid, t, v in rows:
        prior = [(u, x) for _, u, x in rows if u < t]
        if not prior:
            out[rid] = [0.0] * (14 * len(intervals))
            continue
        feats = []
        g = (t - max(u for u, _ in prior)) / D
        for k in intervals:
            w = sorted((u, x) for u, x in prior if u > t - k * D)
            vals = [x for _, x in w]
            a, m, s = _mean(vals), _median(vals), _stdev(vals)
            feats += [_div(v, a), v - a, _div(v, m), v - m, _div(v - a, s), v - a - s]
            feats += _counts(t, [u for u, _ in prior], k)
            us = [u for u, _ in w]
            gaps = [(us[i + 1] - us[i]) / D for i in range(len(us) - 1)]
            feats += _gapf(_mean(gaps), _median(gaps), g)
        out[rid] = feats
    return out


def serve(rows, intervals):
    out = {}
    for rid, t, v in rows:
        prior = [(u, x) for _, u, x in rows if u < t]
        feats = []
        for k in intervals:
            hist = sorted((u, x) for u, x in prior if u > t - k * D)
            if not hist:
                feats += [0.0] * 14
                continue
            vals = [x for _, x in hist] + [v]
            a, m, s = _mean(vals), _median(vals), _stdev(vals)
            feats += [_div(v, a), v - a, _div(v, m), v - m, _div(v - a, s), v - a - s]
            times = [u for u, _ in hist] + [t]
            n = sum(1 for u in times if u > t - D)
            avg_nr = len(times) / k
            per_day = {}
            for u in times:
                day = (u + D // 2) // D
                per_day[day] = per_day.get(day, 0) + 1
            med_nr = _median(list(per_day.values()))
            feats += [_div(n, avg_nr), n - avg_nr, _div(n, med_nr), n - med_nr]
            gaps = [(times[i + 1] - times[i]) / D for i in range(len(times) - 1)]
            g = (t - times[-2]) / D
            feats += _gapf(_mean(gaps), _median(gaps), g)
        out[rid] = feats
    return out


def train(rows, intervals, tie_value=None):
    """Trainer profile.  Drops the oldest row (the first by (us, id)).
    Ties in value statistics keep the value of the first row by (us, id)."""
    srt = sorted(rows, key=lambda r: (r[1], r[0]))
    out = {}
    first_val = {}
    for rid, u, x in srt:
        first_val.setdefault(u, x)
    for j, (rid, t, v) in enumerate(srt):
        if j == 0:
            continue
        prior_us = [u for _, u, _ in srt if u < t]
        prior_vals = {u: first_val[u] for u in prior_us}
        cur = first_val[min(prior_us)] if prior_us else v
        g = (t - max(prior_us)) / D if prior_us else 0.0
        ps = sorted(prior_us)
        gaps = [(ps[i + 1] - ps[i]) / D for i in range(len(ps) - 1)]
        feats = []
        for k in intervals:
            vals = [x for u, x in prior_vals.items() if u > t - k * D]
            a, m, s = _mean(vals), _median(vals), _stdev(vals)
            feats += [_div(cur, a), cur - a, _div(cur, m), cur - m, _div(cur, s), cur - s]
            feats += _counts(t, prior_us, k)
            feats += _gapf(_mean(gaps), _median(gaps), g)
        out[rid] = feats
    return out


# ---------------------------------------------------------------------------
# one row against an entity's earlier rows, as the stream sees them
# ---------------------------------------------------------------------------

def _ratio(a: float, b: float) -> float:
    return a / b if b != 0 else 0.0


def _middle(xs) -> float:
    return float(statistics.median(xs)) if len(xs) else 0.0


def features_for(us_all: np.ndarray, v_all: np.ndarray, newest_before: int | None, t: int, v: float,
                 intervals, profile: str) -> list[float]:
    """Features of one row at time ``t`` from the entity's rows ``us_all``
    (sorted ascending, all strictly before ``t``) and values ``v_all``;
    ``newest_before`` is the newest earlier time even if it is no longer
    kept in ``us_all``."""
    out: list[float] = []
    hi = len(us_all)
    n_today = 1 + hi - int(np.searchsorted(us_all, t - D, side="right"))
    if profile == "canonical":
        if newest_before is None:
            return [0.0] * (14 * len(intervals))
        g = (t - newest_before) / D
        for k in intervals:
            lo = int(np.searchsorted(us_all, t - k * D, side="right"))
            w, u = v_all[lo:hi], us_all[lo:hi]
            a = float(np.mean(w)) if len(w) else 0.0
            m = _middle(w)
            s = float(np.std(w, ddof=1)) if len(w) >= 2 else 0.0
            out += [_ratio(v, a), v - a, _ratio(v, m), v - m, _ratio(v - a, s), v - a - s]
            buckets = [int(np.searchsorted(us_all, t - i * D, side="left") -
                           np.searchsorted(us_all, t - (i + 1) * D, side="right")) for i in range(k)]
            an, mn = float(np.mean(buckets)), _middle(buckets)
            out += [_ratio(n_today, an), n_today - an, _ratio(n_today, mn), n_today - mn]
            gaps = np.diff(u) / D
            ag = float((u[-1] - u[0]) / D / len(gaps)) if len(gaps) else 0.0
            mg = _middle(gaps)
            out += [_ratio(ag, g), ag - g, _ratio(mg, g), mg - g]
        return out
    # serve: history of the interval plus the current row
    for k in intervals:
        lo = int(np.searchsorted(us_all, t - k * D, side="right"))
        if hi - lo == 0:
            out += [0.0] * 14
            continue
        w = np.append(v_all[lo:hi], v)
        u = np.append(us_all[lo:hi], t)
        a = float(np.mean(w))
        m = _middle(w)
        s = float(np.std(w, ddof=1)) if len(w) >= 2 else 0.0
        out += [_ratio(v, a), v - a, _ratio(v, m), v - m, _ratio(v - a, s), v - a - s]
        avg_nr = len(u) / k
        _, per_day = np.unique((u + D // 2) // D, return_counts=True)
        mn = _middle(per_day)
        out += [_ratio(n_today, avg_nr), n_today - avg_nr, _ratio(n_today, mn), n_today - mn]
        gaps = np.diff(u) / D
        g = (t - u[-2]) / D
        ag = float((u[-1] - u[0]) / D / len(gaps))
        mg = _middle(gaps)
        out += [_ratio(ag, g), ag - g, _ratio(mg, g), mg - g]
    return out
