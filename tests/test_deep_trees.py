"""Trees of full depth against Spark's own, and forests against the cuts of their work."""
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fraudframe.operators import classify, deep_trees
from fraudframe.operators.deep_trees import DeepTrees, DeepTreesModel
from fraudframe.sources.replay import scratch_dir


def _xy(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[:, 1], x[:, 2], x[:, 3], x[:, 4] = np.round(x[:, 1]), rng.integers(0, 50, n), 1.0, np.maximum(x[:, 4], 0)
    return x, ((x[:, 0] * x[:, 1] + x[:, 4] > 0.3) ^ (rng.random(n) < 0.2)).astype(int)


def _frame(spark, x, y, parts=3):
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "id long, label int, x array<double>")
    return df.repartition(parts).select("id", "label", array_to_vector("x").alias("features"))


def _p(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()])


@pytest.mark.parametrize("n,small,depth", [(30, 1 << 16, 30), (3000, 1 << 16, 30), (3000, 200, 30), (3000, 300, 6), (3000, 1 << 16, 0)])
def test_one_tree_is_sparks(spark, n, small, depth, monkeypatch):
    """Whether jobs or tasks split the nodes."""
    monkeypatch.setattr(deep_trees, "SMALL", small)
    df = _frame(spark, *_xy(n))
    want = DecisionTreeClassifier(maxDepth=depth).fit(df)
    got = DeepTrees(1, depth, key="id").fit(df)
    assert len(got.trees[0].feature) == want.numNodes
    assert np.array_equal(_p(got, df), _p(want, df))
    x, y = _xy(1000, 9)
    assert np.array_equal(_p(got, _frame(spark, x, y)), _p(want, _frame(spark, x, y)))


def test_forest_whatever_the_cut_and_the_partitions(spark, monkeypatch):
    x, y = _xy(3000)
    other = _xy(3000, 9)
    a = DeepTrees(8, 30, 5, key="id").fit(_frame(spark, x, y))
    monkeypatch.setattr(deep_trees, "SMALL", 700)
    monkeypatch.setattr(deep_trees, "JOB_CELLS", 20_000)
    b = DeepTrees(8, 30, 5, key="id").fit(_frame(spark, x, y, 7))
    assert np.array_equal(a.shares(other[0]), b.shares(other[0]))
    right = ((a.shares(other[0]) > 0.5) == (other[1] == 1)).mean()
    test = _frame(spark, *other)
    spark_right = RandomForestClassifier(numTrees=8, maxDepth=30, seed=5).fit(_frame(spark, x, y)).transform(test).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert abs(right - spark_right) < 0.05
    assert min(len(t.feature) for t in a.trees) > 300


def test_only_large_nodes_take_jobs(spark, monkeypatch):
    """The sums that jobs shuffle don't follow the nodes of the tree."""
    monkeypatch.setattr(deep_trees, "SMALL", 400)
    asked = []
    counts = deep_trees._counts
    monkeypatch.setattr(deep_trees, "_counts", lambda work, *a: asked.extend(n for w in work for n in w[2]) or counts(work, *a))
    model = classify.make_classifier(4, 4000).fit(_frame(spark, *_xy(4000)))
    assert len(model.trees[0].feature) > 1000 and 0 < len(asked) < 60


def test_forest_draws_rows_that_repeat_a_key_on_their_own(spark):
    x, y = _xy(400)
    df = _frame(spark, x, y).withColumn("id", F.lit(1))
    shares = DeepTrees(3, 30, key="id").fit(df).shares(x)
    assert len(np.unique(shares)) > 2 and (((shares > 0.5) == (y == 1)).mean()) > 0.8


def test_bins_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(deep_trees, "FEW_VALUES", 100)
    x, _ = _xy(3000)
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    edges = deep_trees._edges(rows, 3000, 6)
    assert len(edges[3]) == 0 and np.array_equal(edges[1], (np.unique(x[:, 1])[:-1] + np.unique(x[:, 1])[1:]) / 2)
    share = np.diff(np.searchsorted(np.sort(x[:, 0]), np.r_[-9, edges[0], 9])) / 3000
    assert len(edges[0]) == 31 and abs(share - 1 / 32).max() < 0.002


def test_saved_model_and_classes(spark, monkeypatch):
    monkeypatch.setattr(deep_trees, "SAVED_NODES", 100)
    x, y = _xy(1000)
    model = DeepTrees(3, 30, key="id").fit(_frame(spark, x, y))
    path = scratch_dir(spark, "deep-trees-test")
    model.save(spark, path)
    again = DeepTreesModel.load(spark, path, [e.tolist() for e in model.edges], "features")
    assert np.array_equal(again.shares(x), model.shares(x))
    assert DeepTrees(1, 5).fit(_frame(spark, x, y * 0 + 1)).shares(x).min() == 1
    with pytest.raises(ValueError):
        DeepTrees(1, 5).fit(_frame(spark, x, y * 0))


def test_a_model_that_the_driver_does_not_hold(spark, monkeypatch):
    """Trees finished in waves and stored in pieces give the shares of the trees that are held; repeated rows keep their number."""
    x, y = _xy(3000)
    other = _frame(spark, *_xy(2000, 9)).withColumn("id", F.col("id") % 1500)
    held = DeepTrees(8, 30, 5, key="id").fit(_frame(spark, x, y))
    one = DeepTrees(1, 30, key="id").fit(_frame(spark, x, y))
    for name, value in (("SMALL", 300), ("WAVE_ROWS", 7000), ("HELD_NODES", 100), ("SHELF_NODES", 900), ("SENT_BYTES", 1)):
        monkeypatch.setattr(deep_trees, name, value)
    stored = DeepTrees(8, 30, 5, key="id").fit(_frame(spark, x, y, 5))
    assert held.pieces is None and stored.pieces and sum(len(t.feature) for t in stored.trees) < sum(len(t.feature) for t in held.trees) / 10
    path = scratch_dir(spark, "deep-trees-test")
    stored.save(spark, path)
    again = DeepTreesModel.load(spark, path, [e.tolist() for e in stored.edges], "features", True)

    def rows(model):
        return sorted((r[0], r[1], round(r[2], 9), r[3]) for r in model.transform(other).select("id", "label", vector_to_array("probability")[1], "prediction").collect())

    want = rows(held)
    assert len(want) == 2000 and rows(stored) == want and rows(again) == want
    assert stored.transform(other.limit(0)).count() == 0 and stored.transform(other).columns == held.transform(other).columns
    assert rows(DeepTrees(1, 30, key="id").fit(_frame(spark, x, y))) == rows(one)
