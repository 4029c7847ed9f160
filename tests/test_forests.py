import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fraudframe.operators import forests
from fraudframe.operators.select import fit_rfecv


def _table(spark, n=1500, parts=4):
    """Column 1 decides the label, column 3 a little; the others are noise, one of them with gaps."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 5))
    y = ((x[:, 1] + 0.3 * x[:, 3] > 0.2) ^ (rng.random(n) < 0.03)).astype(int)
    x[rng.random(n) < 0.1, 4] = np.nan
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "id long, label int, x array<double>")
    return df.repartition(parts).select("id", "label", array_to_vector("x").alias("features"))


def _read(blocks):
    rows = [(np.frombuffer(r["codes"], np.uint8).reshape(5, -1), np.frombuffer(r["label"], np.int8), np.frombuffer(r["fold"], np.int32),
             np.frombuffer(r["hash"], np.int64)) for r in blocks.collect()]
    return [np.concatenate([r[i] for r in rows], axis=-1) for i in range(4)]


def _gini(w, y):
    one = w[y == 1].sum() / max(w.sum(), 1)
    return w.sum() * 2 * one * (1 - one)


def test_trees_against_brute_force(spark):
    """Every node's split, for two fits at once, is the best that trying all candidates and bins finds."""
    blocks, d = forests.blocks_of(_table(spark), "id", "label", "features", 3, 7)
    codes, y, fold, keys = _read(blocks)
    fits = [forests.Fit(list(range(d)), 0), forests.Fit([0, 1, 4])]
    forests.grow(blocks, fits, 3, 3, 7)
    split = 0
    for fit in fits:
        for t, tree in enumerate(fit.trees):
            weight = forests.draws(keys, t, 7).astype(float) * (fold != fit.fold)
            todo = [(0, np.ones(len(y), bool))]
            while todo:
                node, own = todo.pop()
                w, z = weight[own], y[own]
                assert abs(tree.value[node] - w[z == 1].sum() / w.sum()) < 1e-12
                if tree.feature[node] < 0:
                    continue
                best = max((round(_gini(w, z) - _gini(w[c <= b], z[c <= b]) - _gini(w[c > b], z[c > b]), 7), -f, -b)
                           for f in forests.candidates(fit, t, node, 3, 7) for c in [codes[f][own]] for b in range(forests.BINS))
                assert (tree.feature[node], tree.bin[node]) == (-best[1], -best[2])
                left = own & (codes[tree.feature[node]] <= tree.bin[node])
                todo += [(tree.left[node], left), (tree.right[node], own & ~left)]
                split += 1
        assert abs(fit.importances.sum() - 1) < 1e-9 and fit.importances.argmax() == 1
    assert split > 20
    p = np.mean([t.scores(codes) for t in fits[0].trees], axis=0)
    own = fold == 0
    assert forests.accuracy(blocks, fits[:1]) == [pytest.approx(((p > 0.5) == (y == 1))[own].mean())]
    assert 0.8 < draw_mean(keys) < 1.2


def draw_mean(keys):
    return float(np.mean([forests.draws(keys, t, 1).mean() for t in range(5)]))


def test_elimination_keeps_the_deciding_column_whatever_the_partitions(spark, monkeypatch):
    jobs = []
    level = forests._level
    monkeypatch.setattr(forests, "_level", lambda *a: jobs.append(1) or level(*a))
    found = []
    for parts, folds in ((1, 3), (6, 3), (3, 5)):
        jobs.clear()
        found.append(fit_rfecv(_table(spark, 900, parts), "id", folds=folds, num_trees=4, max_depth=2).indices)
        assert len(jobs) <= 5 * 2  # sizes x depth, whatever the folds
    assert found[0] == found[1] and all(1 in f for f in found)


def test_forest_without_training_rows(spark):
    blocks, d = forests.blocks_of(_table(spark, 40, 1).withColumn("id", F.lit(1)), "id", "label", "features", 2, 0)
    fits = [forests.Fit(list(range(d)), f) for f in (0, 1)]
    forests.grow(blocks, fits, 2, 2, 0)
    assert min(len(f.trees[0].feature) for f in fits) == 1  # all rows are in one fold
    assert 0.0 in forests.accuracy(blocks, fits)


@pytest.mark.parametrize("rows", [200, 40_000])
def test_rows_that_are_alike_are_counted_once(spark, rows, monkeypatch):
    """Counts of two columns' trees, from single rows and from merged ones, against a plain count."""
    rng = np.random.default_rng(rows)
    codes, y, fold = rng.integers(0, 33, (3, rows)).astype(np.uint8), rng.integers(0, 2, rows).astype(np.int8), rng.integers(0, 3, rows).astype(np.int32)
    keys = rng.integers(-2 ** 62, 2 ** 62, rows)
    tree = forests.Tree()
    tree.split(0, 2, 9, True)
    work = [(1, 4, tree, [1, 2], [[0, 2], [2, 0]]), (forests.ALL_ROWS, 5, forests.Tree(), [0], [[0, 2]])]
    seen = []
    add = forests._add
    monkeypatch.setattr(forests, "_add", lambda *a: seen.append(a[1].shape[1]) or add(*a))
    batch = pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (codes, y, fold, keys)], ["codes", "label", "fold", "hash"])
    found = {b.column(0)[0].as_py(): np.frombuffer(b.column(1)[0].as_py()) for b in forests._counts(work, 7)([batch])}
    assert sum(seen) <= 2 * 2 * 33 ** 2 + (rows < 8 * 33 ** 2) * 2 * rows       # 80,000 rows are not counted one by one
    for i, (left_out, number, t, nodes, features) in enumerate(work):
        want = np.zeros((len(nodes), 2, forests.WIDTH, 2))
        weight, at = forests.draws(keys, number, 7), t.nodes(codes)
        for r in np.flatnonzero(fold != left_out):
            for j, f in enumerate(features[nodes.index(at[r])] if at[r] in nodes else []):
                want[nodes.index(at[r]), j, codes[f, r], y[r]] += weight[r]
        assert np.array_equal(want.ravel(), found[i])


def test_nodes_by_table_and_by_walk(monkeypatch):
    from fraudframe.operators import boost
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 200, (4, 3000)).astype(np.uint8)
    tree, leaves = boost.Tree(), [0]
    for _ in range(40):
        node = leaves.pop(rng.integers(0, len(leaves)) if rng.random() < 0.5 else -1)
        leaves += tree.split(node, int(rng.integers(0, 4)), int(rng.integers(1, 200)), bool(rng.integers(0, 2)))
    table = tree.nodes(codes)
    monkeypatch.setattr(boost, "TABLE_NODES", 0)
    assert np.array_equal(table, tree.nodes(codes)) and len(set(table)) > 3
