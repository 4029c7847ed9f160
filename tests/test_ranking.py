import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudframe.functions import ranking as R


@pytest.mark.parametrize("per_bucket", [1_000_000, 997])
def test_index_sorted_total_order(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", per_bucket)
    df = spark.range(0, 50_000).select((F.col("id") * 7919 % 100_003).alias("k"), "id").repartition(7)
    rows = R.index_sorted(df, ["k", "id"], "r").collect()
    got = [r["k"] for r in sorted(rows, key=lambda r: r["r"])]
    assert [r["r"] for r in sorted(rows, key=lambda r: r["r"])] == list(range(50_000))
    assert got == sorted(got)


@pytest.mark.parametrize("per_bucket", [1_000_000, 50])
def test_exact_quantiles_hot_value(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", per_bucket)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 4000).round(3), np.full(2000, 0.5)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = R.exact_quantiles(df, "x", probs)
    assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_string_ranks(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 10)
    vals = ["b", "a", "Z", "é", "aa", "10", "9", "", "zz", "ß"] * 3
    df = spark.createDataFrame([(v,) for v in sorted(set(vals))], "v string")
    got = [r["v"] for r in sorted(R.index_sorted(df, ["v"], "r").collect(), key=lambda r: r["r"])]
    assert got == sorted(set(vals))


@pytest.mark.parametrize("per_bucket", [1_000_000, 40])
def test_exact_quantiles_of_several_columns(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", per_bucket)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=900).round(2), np.where(rng.random(900) < 0.4, 7.0, rng.integers(0, 300, 900))
    df = spark.createDataFrame([(float(a), int(b) if i % 9 else None, None) for i, (a, b) in enumerate(zip(x, y))],
                               "x double, y int, empty double").repartition(3)
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    got = R.exact_quantiles_of(df, ["x", "y", "empty"], probs)
    assert np.allclose(got["x"], np.quantile(x, probs), rtol=0, atol=1e-12)
    assert np.allclose(got["y"], np.quantile([b for i, b in enumerate(y) if i % 9], probs), rtol=0, atol=1e-12)
    assert got["empty"] == [None] * len(probs) and R.exact_quantiles_of(df, [], probs) == {}
