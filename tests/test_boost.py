"""Boosted trees against a plain restatement, and held-out against Spark's own boosting."""
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fraudframe.operators.boost import LEAF_WISE, REGULARISED, BoostedTrees, BoostedTreesModel


def make(n, missing, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = ((x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.2) > 0.3).astype(int)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [([None if np.isnan(v) else float(v) for v in r], int(c)) for r, c in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label int").select(
        array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))).alias("features"), "label").repartition(3)


def brute_force(x, y, p):
    """Every split of every leaf by trying all values of all features, row by row."""
    base = np.log(y.sum() / (len(y) - y.sum()))
    score = np.full(len(y), base)
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)

        def best(rows):
            found = None
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j][~np.isnan(x[rows, j])]):
                    for to_left in (False, True):
                        left = np.where(np.isnan(x[rows, j]), to_left, x[rows, j] <= cut)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < max(p.min_rows, 1) or min(h[a].sum(), h[b].sum()) < p.min_hessian:
                            continue
                        gain = (g[a].sum() ** 2 / (h[a].sum() + p.l2) + g[b].sum() ** 2 / (h[b].sum() + p.l2) - g[rows].sum() ** 2 / (h[rows].sum() + p.l2)) / 2 - p.min_gain
                        if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                            found = gain, a, b
            return found

        leaves = [(np.arange(len(y)), 0)]
        splits = {0: best(leaves[0][0])}
        if p.growth == "leaf":
            while len(leaves) < p.leaves and any(splits[i] for i in range(len(leaves))):
                i = max((i for i in range(len(leaves)) if splits[i]), key=lambda i: splits[i][0])
                _, a, b = splits[i]
                leaves[i], splits[i] = (a, 0), best(a)
                leaves.append((b, 0))
                splits[len(leaves) - 1] = best(b)
        else:
            done = []
            while leaves:
                rows, depth = leaves.pop()
                found = best(rows) if depth < p.depth else None
                if found:
                    leaves += [(found[1], depth + 1), (found[2], depth + 1)]
                else:
                    done.append((rows, depth))
            leaves = done
        for rows, _ in leaves:
            score[rows] -= g[rows].sum() / (h[rows].sum() + p.l2) * p.step
    return score


@pytest.mark.parametrize("params,missing", [
    (replace(LEAF_WISE, rounds=4, leaves=6, min_rows=5), 0.0), (replace(LEAF_WISE, rounds=3, leaves=7, min_rows=8), 0.15),
    (replace(REGULARISED, rounds=4, depth=3), 0.15), (replace(REGULARISED, rounds=3, depth=4, min_gain=0.5, l2=3.0), 0.0)])
def test_equals_brute_force(spark, params, missing):
    x, y = make(200, missing)
    model = BoostedTrees(params).fit(frame(spark, x, y))
    assert np.allclose(model.margins(x), brute_force(x, y, params), rtol=0, atol=1e-9)
    again = BoostedTreesModel.from_json(model.to_json())
    assert np.array_equal(again.margins(x), model.margins(x))
    scored = model.transform(frame(spark, x, y)).collect()
    assert len(scored) == 200 and all(abs(r.probability[0] + r.probability[1] - 1) < 1e-12 and r.prediction == float(r.probability[1] > 0.5) for r in scored)


def test_scores_are_carried_over_stored_blocks(spark):
    """More trees than are kept beside the blocks."""
    x, y = make(300, 0.1)
    params = replace(REGULARISED, rounds=23, depth=2)
    assert np.allclose(BoostedTrees(params).fit(frame(spark, x, y)).margins(x), brute_force(x, y, params), rtol=0, atol=1e-8)


def loss(p, y):
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.mark.parametrize("params,step,depth", [(replace(LEAF_WISE, rounds=15, step=0.2), 0.1, 5), (replace(REGULARISED, rounds=15), 0.15, 6)])
def test_held_out_loss_is_below_fixed_depth_boosting(spark, params, step, depth):
    """Spark's boosting takes the logistic function of twice the margin, so its steps count twice."""
    from pyspark.ml.classification import GBTClassifier

    x, y = make(3000, 0.0)
    train, test = frame(spark, x[:2000], y[:2000]).cache(), frame(spark, x[2000:], y[2000:])
    plain = GBTClassifier(maxIter=15, stepSize=step, maxDepth=depth, seed=0).fit(train).transform(test).select("label", "probability").collect()
    plain = loss(np.array([r.probability[1] for r in plain]), np.array([r.label for r in plain]))
    odds = BoostedTrees(params).fit(train).margins(x[2000:])
    assert loss(1 / (1 + np.exp(-odds)), y[2000:]) < plain


def test_missing_side_is_learnt(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 0.5).astype(int)
    x[y == 1, 0] = np.nan      # only the missing value tells the class
    model = BoostedTrees(replace(REGULARISED, rounds=5)).fit(frame(spark, x, y))
    assert ((model.margins(x) > 0) == (y == 1)).all()
    with pytest.raises(ValueError):
        BoostedTrees(REGULARISED).fit(frame(spark, x, np.zeros(400, int)))
