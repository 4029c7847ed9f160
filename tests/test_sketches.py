import numpy as np
import pytest

from fraudframe.functions import sketches
from fraudframe.operators.scale import fit_scaler


def test_sketch_ranks_within_error(spark):
    """Skewed values, one value in a third of the rows, NULL and NaN; ranks counted by numpy."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(9, 40_000), np.full(20_000, 2.0)])
    rows = [(float(v), int(v * 100)) for v in x] + [(None, None)] * 50 + [(float("nan"), None)] * 50
    df = spark.createDataFrame(rows, "`a.b` double, c long").repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = sketches.sketch_quantiles_of(df, ["a.b", "c"], probs)
    for name, values in (("a.b", x), ("c", (x * 100).astype(int))):
        values = np.sort(values)
        for p, q in zip(probs, got[name]):
            lo, hi = np.searchsorted(values, q, "left") / len(x), np.searchsorted(values, q, "right") / len(x)
            assert lo - 0.001 <= p <= hi + 0.001
        assert (got[name][0], got[name][-1]) == (values[0], values[-1])
    off = sketches.sketch_ranks(df, ["a.b", "c"], probs).collect()
    assert len(off) == 14 and all(r["n"] == len(x) and r["rank_off"] <= 0.001 for r in off)
    assert sketches.rank_error() < 0.001


def test_sketch_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), None)], "a double, b double")
    assert sketches.sketch_quantiles_of(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}
    assert sketches.sketch_quantiles_of(df.limit(0), ["a", "b"], [0.5]) == {"a": [None], "b": [None]}


def test_sketch_shuffles_no_values(spark):
    df = spark.range(100_000).selectExpr("cast(id as double) x").repartition(3)
    plan = sketches.quantile_sketches(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("kll_sketch_agg_double"):]
    assert "partial_kll_sketch_agg_double" in before


def test_scalers_from_sketches(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 2, 20_000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(4)
    exact, near = (fit_scaler(df, ["x"], "robust", q).params["x"] for q in ("exact", "sketch"))
    assert np.allclose(exact, near, atol=0.02)
    got = np.array([r["x"] for r in sorted(fit_scaler(df, ["x"], "quantile_uniform", "sketch").transform(df).collect(), key=lambda r: r["id"])])
    assert np.abs(got - np.argsort(np.argsort(x)) / (len(x) - 1)).max() <= 0.002
    with pytest.raises(ValueError):
        fit_scaler(df, ["x"], "robust", "other")
