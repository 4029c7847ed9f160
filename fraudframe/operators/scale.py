"""Scalers (survey 2.F).  Each is fitted by aggregates into a few numbers per
column (kept on the driver) and applied as a column projection.  The
scaling rules follow the common library conventions: a zero scale (constant
column) is replaced by 1, so a constant column maps to 0.

standard   (x - mean) / population deviation
min_max    (x - min) / (max - min)
max_abs    x / max |x|
robust     (x - median) / (q75 - q25), exact quantiles of all columns at once
normalizer row / L2 norm of the row (no fit)
quantile_uniform / quantile_normal: x mapped through its empirical CDF on
           a grid of up to 1000 exact quantiles, then (normal) through the
           inverse standard normal CDF, clipped at 1e-7 / 1 - 1e-7.

robust and the quantile kinds take their quantiles exactly, or with
``quantiles="sketch"`` from mergeable sketches (one pass, no shuffle of values,
ranks within ``functions.sketches.rank_error`` of the rows).
"""
from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudframe.functions.ranking import exact_quantiles_of
from fraudframe.functions.sketches import sketch_quantiles_of

KINDS = ("standard", "min_max", "max_abs", "robust", "normalizer", "quantile_uniform", "quantile_normal")
QUANTILES = {"exact": exact_quantiles_of, "sketch": sketch_quantiles_of}
N_QUANTILES = 1000
BOUND = 1e-7


def _nz(x: float | None) -> float:
    return 1.0 if x is None or x == 0 else float(x)


@dataclass
class ScalerModel:
    kind: str
    columns: list[str]
    params: dict[str, tuple] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        k = self.kind
        if k == "normalizer":
            norm = F.sqrt(sum((F.col(c).cast("double") ** 2 for c in self.columns), F.lit(0.0)))
            scale = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
            return df.withColumns({c: F.col(c).cast("double") / scale for c in self.columns})
        if k.startswith("quantile"):
            return df.withColumns({c: _quantile_udf(self.params[c][0], self.params[c][1], k == "quantile_normal")(
                F.col(c).cast("double")) for c in self.columns})
        out = {}
        for c in self.columns:
            center, scale = self.params[c]
            out[c] = (F.col(c).cast("double") - F.lit(center)) / F.lit(scale)
        return df.withColumns(out)


def fit_scaler(df: DataFrame, columns: list[str], kind: str, quantiles: str = "exact") -> ScalerModel:
    if kind not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}; one of {KINDS}")
    if quantiles not in QUANTILES:
        raise ValueError(f"unknown quantiles {quantiles!r}; one of {tuple(QUANTILES)}")
    quantiles_of = QUANTILES[quantiles]
    params: dict[str, tuple] = {}
    if kind == "normalizer":
        return ScalerModel(kind, columns, params)
    if kind in ("standard", "min_max", "max_abs"):
        aggs = []
        for i, c in enumerate(columns):
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                     F.max(x).alias(f"hi{i}"), F.max(F.abs(x)).alias(f"a{i}")]
        r = df.agg(*aggs).first()
        for i, c in enumerate(columns):
            if kind == "standard":
                params[c] = (r[f"m{i}"] or 0.0, _nz(r[f"s{i}"]))
            elif kind == "min_max":
                params[c] = (r[f"lo{i}"] or 0.0, _nz(None if r[f"hi{i}"] is None else r[f"hi{i}"] - r[f"lo{i}"]))
            else:
                params[c] = (0.0, _nz(r[f"a{i}"]))
        return ScalerModel(kind, columns, params)
    if kind == "robust":
        for c, (q25, q50, q75) in quantiles_of(df, columns, [0.25, 0.5, 0.75]).items():
            params[c] = (q50 or 0.0, _nz(None if q25 is None else q75 - q25))
        return ScalerModel(kind, columns, params)
    # quantile transformer: grid of quantiles at evenly spaced levels
    n = df.count()
    nq = max(2, min(N_QUANTILES, n))
    refs = list(np.linspace(0.0, 1.0, nq))
    for c, grid in quantiles_of(df, columns, refs).items():
        params[c] = (grid, refs)
    return ScalerModel(kind, columns, params)


def scale(df: DataFrame, columns: list[str], kind: str, quantiles: str = "exact") -> DataFrame:
    return fit_scaler(df, columns, kind, quantiles).transform(df)


def quantile_map(x: np.ndarray, quantiles: np.ndarray, refs: np.ndarray, normal: bool) -> np.ndarray:
    """Empirical-CDF mapping: the mean of interpolating from below and from
    above, so repeated grid values map to the middle of their levels."""
    up = np.interp(x, quantiles, refs)
    down = -np.interp(-x, -quantiles[::-1], -refs[::-1])
    y = 0.5 * (up + down)
    y = np.where(x <= quantiles[0], refs[0], y)
    y = np.where(x >= quantiles[-1], refs[-1], y)
    if normal:
        z = np.clip(y, BOUND, 1 - BOUND)
        y = np.frompyfunc(NormalDist().inv_cdf, 1, 1)(z).astype(float)
        lo, hi = NormalDist().inv_cdf(BOUND), NormalDist().inv_cdf(1 - BOUND)
        y = np.clip(y, lo, hi)
    return y


def _quantile_udf(quantiles, refs, normal: bool):
    q = np.asarray(quantiles, dtype=float)
    r = np.asarray(refs, dtype=float)

    @F.pandas_udf(T.DoubleType())
    def f(s: pd.Series) -> pd.Series:
        x = s.to_numpy(dtype=float, na_value=np.nan)
        out = quantile_map(x, q, r, normal)
        out[np.isnan(x)] = np.nan
        return pd.Series(out)

    return f
