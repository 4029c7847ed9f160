"""ANSI/DuckDB SQL text of the look-back features, written independently of
the DataFrame operator: it is the oracle the driver compares against.

``src`` must be a query (or view) with columns ``id, card, us, v`` where
``us`` is whole microseconds.  Output: ``id`` plus the feature columns.
"""
from __future__ import annotations

from fraudframe.operators.lookback import feature_names

D = 86_400_000_000


def _w(lo: str, hi: str) -> str:
    return f"OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {lo} AND {hi})"


def _prec(n: int) -> str:
    return f"{n} PRECEDING"


def _div(a: str, b: str) -> str:
    return f"COALESCE(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END, 0.0)"


def _median_list(expr: str) -> str:
    return f"COALESCE(list_aggregate({expr}, 'median'), 0.0)"


def _bucket_cols(max_k: int) -> list[str]:
    return [f"count(*) {_w(_prec((i + 1) * D - 1), _prec(i * D + 1))} AS b{i}" for i in range(max_k)]


def _count_feats(k: int, n: str) -> list[str]:
    bl = "[" + ", ".join(f"b{i}" for i in range(k)) + "]"
    avg = f"(({' + '.join(f'b{i}' for i in range(k))}) / {float(k)})"
    med = _median_list(bl)
    return [_div(n, avg), f"{n} - {avg}", _div(n, med), f"{n} - {med}"]


def _gap_feats(avg_gap: str, med_gap: str, g: str) -> list[str]:
    return [_div(avg_gap, g), f"{avg_gap} - {g}", _div(med_gap, g), f"{med_gap} - {g}"]


def canonical_sql(src: str, value: str, intervals, round_to: int | None = 20) -> str:
    max_k = max(intervals)
    stats = [
        f"count(*) {_w('UNBOUNDED PRECEDING', '1 PRECEDING')} AS n_prior",
        f"max(us) {_w('UNBOUNDED PRECEDING', '1 PRECEDING')} AS last_us",
        *_bucket_cols(max_k),
    ]
    for k in intervals:
        f = _w(_prec(k * D - 1), "1 PRECEDING")
        stats += [
            f"COALESCE(avg(v) {f}, 0.0) AS avg{k}",
            f"COALESCE(quantile_cont(v, 0.5) {f}, 0.0) AS med{k}",
            f"COALESCE(stddev_samp(v) {f}, 0.0) AS dev{k}",
            f"list_sort(list(us) {f}) AS ul{k}",
        ]
    names = feature_names(value, intervals)
    sel, i = [], 0
    g = f"COALESCE((us - last_us) / {float(D)}, 0.0)"
    for k in intervals:
        a, m, s, ul = f"avg{k}", f"med{k}", f"dev{k}", f"ul{k}"
        gaps = f"list_transform(range(1, len({ul})), lambda j: {ul}[j + 1] - {ul}[j])"
        avg_gap = f"(CASE WHEN len({ul}) >= 2 THEN ({ul}[len({ul})] - {ul}[1]) / {float(D)} / (len({ul}) - 1) ELSE 0.0 END)"
        med_gap = f"({_median_list(gaps)} / {float(D)})"
        cols = [_div("v", a), f"v - {a}", _div("v", m), f"v - {m}", _div(f"v - {a}", s), f"v - {a} - {s}",
                *_count_feats(k, "(b0 + 1.0)"), *_gap_feats(avg_gap, med_gap, g)]
        for c in cols:
            expr = f"CASE WHEN n_prior > 0 THEN {c} ELSE 0.0 END"
            sel.append(f"{_round(expr, round_to)} AS {names[i]}")
            i += 1
    return (f"WITH s AS (SELECT *, {', '.join(stats)} FROM ({src}) src)\n"
            f"SELECT id, {', '.join(sel)} FROM s")


def serve_sql(src: str, value: str, intervals, round_to: int | None = 20) -> str:
    stats = [f"count(*) {_w(_prec(D - 1), '1 PRECEDING')} AS day_n"]
    for k in intervals:
        f = _w(_prec(k * D - 1), "1 PRECEDING")
        stats += [f"count(*) {f} AS h{k}", f"list(v) {f} AS vl{k}", f"list_sort(list(us) {f}) AS ul{k}"]
    names = feature_names(value, intervals)
    sel, i = [], 0
    for k in intervals:
        vals = f"list_concat(vl{k}, [v])"
        times = f"list_concat(ul{k}, [us])"
        a = f"list_avg({vals})"
        m = f"list_aggregate({vals}, 'median')"
        s = f"COALESCE(list_stddev_samp({vals}), 0.0)"
        n = "(day_n + 1.0)"
        avg_nr = f"(len({times}) / {float(k)})"
        days = f"list_transform({times}, lambda u: floor((u + {D // 2}) / {D}))"
        per_day = f"list_transform(list_distinct({days}), lambda d: len(list_filter({days}, lambda x: x = d)))"
        med_nr = f"list_aggregate({per_day}, 'median')"
        gaps = f"list_transform(range(1, len({times})), lambda j: {times}[j + 1] - {times}[j])"
        g = f"((us - {times}[len({times}) - 1]) / {float(D)})"
        avg_gap = f"(({times}[len({times})] - {times}[1]) / {float(D)} / (len({times}) - 1))"
        med_gap = f"(list_aggregate({gaps}, 'median') / {float(D)})"
        cols = [_div("v", a), f"v - {a}", _div("v", m), f"v - {m}", _div(f"v - {a}", s), f"v - {a} - {s}",
                _div(n, avg_nr), f"{n} - {avg_nr}", _div(n, med_nr), f"{n} - {med_nr}",
                *_gap_feats(avg_gap, med_gap, g)]
        for c in cols:
            expr = f"CASE WHEN h{k} > 0 THEN {c} ELSE 0.0 END"
            sel.append(f"{_round(expr, round_to)} AS {names[i]}")
            i += 1
    return (f"WITH s AS (SELECT *, {', '.join(stats)} FROM ({src}) src)\n"
            f"SELECT id, {', '.join(sel)} FROM s")


def train_sql(src: str, value: str, intervals, round_to: int | None = 20) -> str:
    """Trainer profile; rows of one entity and time are ordered by id, and one
    value (the first) stands for them."""
    max_k = max(intervals)
    stats = [
        f"count(*) {_w('UNBOUNDED PRECEDING', '1 PRECEDING')} AS n_prior",
        f"max(us) {_w('UNBOUNDED PRECEDING', '1 PRECEDING')} AS last_us",
        f"min(us) {_w('UNBOUNDED PRECEDING', '1 PRECEDING')} AS first_us",
        f"first_value(v) OVER (PARTITION BY card ORDER BY us, id) AS first_v",
        f"quantile_cont(gap, 0.5) {_w('UNBOUNDED PRECEDING', '1 PRECEDING')} AS med_gap_all",
        "row_number() OVER (PARTITION BY card ORDER BY us, id) AS rn",
        *_bucket_cols(max_k),
    ]
    for k in intervals:
        f = _w(_prec(k * D - 1), "1 PRECEDING")
        stats += [
            f"COALESCE(avg(v_one) {f}, 0.0) AS avg{k}",
            f"COALESCE(quantile_cont(v_one, 0.5) {f}, 0.0) AS med{k}",
            f"COALESCE(stddev_samp(v_one) {f}, 0.0) AS dev{k}",
        ]
    names = feature_names(value, intervals)
    sel, i = [], 0
    cur = "(CASE WHEN n_prior > 0 THEN first_v ELSE v END)"
    g = f"COALESCE((us - last_us) / {float(D)}, 0.0)"
    avg_gap = f"(CASE WHEN n_prior >= 2 THEN (last_us - first_us) / {float(D)} / (n_prior - 1) ELSE 0.0 END)"
    med_gap = f"(COALESCE(med_gap_all, 0.0) / {float(D)})"
    for k in intervals:
        a, m, s = f"avg{k}", f"med{k}", f"dev{k}"
        cols = [_div(cur, a), f"{cur} - {a}", _div(cur, m), f"{cur} - {m}", _div(cur, s), f"{cur} - {s}",
                *_count_feats(k, "(b0 + 1.0)"), *_gap_feats(avg_gap, med_gap, g)]
        for c in cols:
            sel.append(f"{_round(c, round_to)} AS {names[i]}")
            i += 1
    return (f"WITH g AS (SELECT *, us - lag(us) OVER (PARTITION BY card ORDER BY us, id) AS gap FROM ({src}) src),\n"
            f"s AS (SELECT *, {', '.join(stats)} FROM "
            f"(SELECT *, CASE WHEN gap IS NULL OR gap <> 0 THEN v END AS v_one FROM g) o)\n"
            f"SELECT id, {', '.join(sel)} FROM s WHERE rn > 1")


def _round(expr: str, bits: int | None) -> str:
    """Snap to a binary grid of 2**-bits: exact IEEE steps, so identical
    inputs give identical outputs in every engine (decimal rounding of a
    double is not: engines disagree on decimal ties such as x.xxxxxx5)."""
    return expr if bits is None else snap_sql(expr, bits)


def snap_sql(expr: str, bits: int = 20) -> str:
    scale = float(1 << bits)
    return f"(floor(({expr}) * CAST({scale} AS DOUBLE) + 0.5) / CAST({scale} AS DOUBLE))"
