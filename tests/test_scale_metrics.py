import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudframe.operators.metrics import METRIC_COLUMNS, binary_metrics
from fraudframe.operators.scale import fit_scaler


def _reference_quantile(x, normal):
    nq = min(1000, len(x))
    refs = np.linspace(0, 1, nq)
    q = np.percentile(x, refs * 100)
    y = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    if normal:
        y[x - 1e-7 < q[0]] = 0.0
        y[x + 1e-7 > q[-1]] = 1.0
        lo, hi = NormalDist().inv_cdf(1e-7), NormalDist().inv_cdf(1 - 1e-7)
        return np.array([lo if v <= 0 else hi if v >= 1 else min(max(NormalDist().inv_cdf(v), lo), hi) for v in y])
    y[x == q[0]] = 0.0
    y[x == q[-1]] = 1.0
    return y


@pytest.mark.parametrize("kind", ["quantile_uniform", "quantile_normal"])
def test_quantile_transformer(spark, kind):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(3, 1500).round(2), np.full(300, 2.0)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(4)
    out = fit_scaler(df, ["x"], kind).transform(df)
    got = np.array([r["x"] for r in sorted(out.collect(), key=lambda r: r["id"])])
    assert np.allclose(got, _reference_quantile(x, kind == "quantile_normal"), atol=1e-9)


@pytest.mark.parametrize("kind,fn", [
    ("standard", lambda x: (x - x.mean()) / x.std()),
    ("min_max", lambda x: (x - x.min()) / (x.max() - x.min())),
    ("max_abs", lambda x: x / np.abs(x).max()),
    ("robust", lambda x: (x - np.median(x)) / (np.percentile(x, 75) - np.percentile(x, 25))),
])
def test_column_scalers(spark, kind, fn):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, 777)
    df = spark.createDataFrame([(i, float(v), 3.0) for i, v in enumerate(x)], "id long, x double, c double")
    out = sorted(fit_scaler(df, ["x", "c"], kind).transform(df).collect(), key=lambda r: r["id"])
    assert np.allclose([r["x"] for r in out], fn(x), atol=1e-9)
    assert all(r["c"] == (0.0 if kind != "max_abs" else 1.0) for r in out)  # constant column


def test_normalizer(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "a double, b double")
    rows = fit_scaler(df, ["a", "b"], "normalizer").transform(df).collect()
    assert (rows[0]["a"], rows[0]["b"]) == (0.6, 0.8) and (rows[1]["a"], rows[1]["b"]) == (0.0, 0.0)


def _frame(spark, c00, c01, c10, c11):
    rows = [(0, 0)] * c00 + [(0, 1)] * c01 + [(1, 0)] * c10 + [(1, 1)] * c11
    return spark.createDataFrame(rows, "label int, prediction int")


def test_metrics_standard_values(spark):
    m = binary_metrics(_frame(spark, 50, 10, 5, 35)).first().asDict()
    tp, fp, fn, tn = 35, 10, 5, 50
    p, r = tp / (tp + fp), tp / (tp + fn)
    assert (m["TP"], m["FP"], m["FN"], m["TN"]) == (tp, fp, fn, tn)
    assert math.isclose(m["f1"], 2 * p * r / (p + r))
    assert math.isclose(m["f2"], 5 * p * r / (4 * p + r))
    assert math.isclose(m["MCC"], (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    assert math.isclose(m["ROCAUC"], m["balanced_accuracy"])
    assert math.isclose(m["Youdens_statistic"], r + tn / (tn + fp) - 1)


def test_metrics_reference_identities(spark):
    df = _frame(spark, 50, 10, 5, 35)
    std = binary_metrics(df).first().asDict()
    ref = binary_metrics(df, convention="reference").first().asDict()
    # the original's names computed with class 0 as "positive"
    assert math.isclose(ref["sensitivity"], std["NPV"])
    assert math.isclose(ref["specificity"], std["prec"])
    assert math.isclose(ref["prec"], std["specificity"])
    assert math.isclose(ref["NPV"], std["recall"])
    assert math.isclose(ref["FNR"], std["F_OR"]) and math.isclose(ref["F_OR"], std["FNR"])
    assert math.isclose(ref["FPR"], std["FDR"]) and math.isclose(ref["FDR"], std["FPR"])
    assert math.isclose(ref["MCC"], std["MCC"]) and ref["recall"] == std["recall"]
    assert math.isclose(ref["Youdens_statistic"], std["NPV"] + std["prec"] - 1)


def test_metrics_zero_denominators(spark):
    m = binary_metrics(_frame(spark, 10, 0, 0, 0)).first().asDict()
    assert set(m) == set(METRIC_COLUMNS)
    assert m["prec"] == 0.0 and m["recall"] == 0.0 and m["MCC"] == 0.0 and m["f1"] == 0.0


def test_score_auc_counts_pairs(spark):
    import numpy as np

    from fraudframe.operators.metrics import score_auc
    rng = np.random.default_rng(4)
    y, x = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "label int, positive_probability double")
    pos, neg = x[y == 1][:, None], x[y == 0][None, :]
    assert math.isclose(score_auc(df), float(((pos > neg) + 0.5 * (pos == neg)).mean()))


def test_discriminant_equals_the_closed_form(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from fraudframe.operators.classify import LinearDiscriminant
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + y[:, None] * [1.0, -2.0, 0.5]
    moved = x + [1e6, -1e6, 0]  # an offset that sums of squares would lose
    df = spark.createDataFrame([(int(a), Vectors.dense(v)) for a, v in zip(y, moved)], ["label", "features"])
    got = LinearDiscriminant().fit(df)
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    r = x - np.where(y[:, None] == 1, m1, m0)
    want = np.linalg.solve(r.T @ r / (len(y) - 2), m1 - m0)
    assert np.allclose(got.weights, want, rtol=1e-5)
    out = [row["prediction"] for row in got.transform(df).collect()]
    score = (x - (m0 + m1) / 2) @ want + np.log(y.sum() / (1 - y).sum())
    assert [int(p) for p in out] == (score > 0).astype(int).tolist()
