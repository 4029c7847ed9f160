import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudframe.operators import knn as K
from fraudframe.operators.resample import RatioAlreadyReached, over_sample, split_train_test, under_sample
from fraudframe.sources.testdata import event_transactions, table
from tests.conftest import SF001, SF01


def _brute(X, ids, Q, qids, k, exclude):
    out = {}
    for qi, q in zip(qids, Q):
        d = np.sqrt(((X - q) ** 2).sum(1))
        order = sorted((d[j], ids[j]) for j in range(len(ids)) if not (exclude and ids[j] == qi))
        out[qi] = [i for _, i in order[:k]]
    return out


@pytest.mark.parametrize("block", [2048, 37])
def test_knn_exact_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QBLOCK", block)
    emb = table(spark, SF01, "embeddings")
    got = {}
    for r in K.knn(emb, emb, 5, "vec_id", "vec_id", "embedding", exclude_same_id=True).collect():
        got.setdefault(r["q_vec_id"], []).append((r["nn_rank"], r["r_vec_id"]))
    got = {q: [i for _, i in sorted(v)] for q, v in got.items()}
    rows = emb.collect()
    X = np.array([r["embedding"] for r in rows], dtype=float)
    ids = [r["vec_id"] for r in rows]
    want = _brute(X, ids, X, ids, 5, True)
    assert got == want


def test_best_first_visits_few_rows(spark, monkeypatch):
    """Rows in clusters: exact, with ties by id, while most cells are never visited."""
    monkeypatch.setattr(K, "BLOCK", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 3)) * 20
    X = np.round(centres[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 3)) * 0.5, 1)
    X[100:160] = X[100]      # copies
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(X)], "id long, v array<double>, c int").repartition(4)
    report = {}
    got = {}
    for r in K.knn(df, df, 4, "id", "id", "v", exclude_same_id=True, carry=["c"], report=report).collect():
        got.setdefault(r["q_id"], []).append((r["nn_rank"], r["r_id"], r["c"]))
    assert {q: [i for _, i, _ in sorted(v)] for q, v in got.items()} == _brute(X, range(1200), X, range(1200), 4, True)
    assert all(c == i % 3 for v in got.values() for _, i, c in v)
    assert report["visited"] < 0.2 and report["rounds"] >= 2
    assert K.knn(df.limit(0), df, 4, "id", "id", "v").count() == 0
    few = K.knn(df.filter("id < 5"), df.filter("id in (7, 8)"), 4, "id", "id", "v").collect()
    assert len(few) == 10 and all(r["nn_rank"] <= 2 for r in few)


@pytest.mark.parametrize("key", ["id", None])
def test_classifier_ties_do_not_follow_the_partitions(spark, key):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, [float(i % 4), float(i // 4 % 3)], i % 2) for i in range(60)]      # five copies of each point, of both classes
    outs = []
    for parts, order in ((1, rows), (5, rows[::-1])):
        df = spark.createDataFrame(order, "id long, v array<double>, y int").repartition(parts).select("id", "y", array_to_vector("v").alias("features"))
        model = K.KNNClassifier(k=3, label="y", key=key).fit(df)
        outs.append({r["id"]: r["probability"][1] for r in model.transform(df, key="id").select("id", "probability").collect()})
    assert outs[0] == outs[1]


def test_split_exact_size(spark):
    tx = event_transactions(spark, SF001)
    n = tx.count()
    s = split_train_test(tx, "id", 0.25, 0)
    assert s.filter("is_test").count() == -(-n // 4)
    assert s.count() == n
    again = split_train_test(tx.repartition(5), "id", 0.25, 0).filter("is_test").select("id")
    assert sorted(r[0] for r in again.collect()) == sorted(r[0] for r in s.filter("is_test").select("id").collect())


def test_under_over_sample(spark):
    tx = event_transactions(spark, SF01)
    n1 = tx.filter("fraud = 1").count()
    n0 = tx.filter("fraud = 0").count()
    u = under_sample(tx, "fraud", "id")
    assert u.filter("fraud = 0").count() == int(n1 / 0.5) and u.filter("fraud = 1").count() == n1
    o = over_sample(tx, "fraud", "id")
    assert o.filter("fraud = 1").count() == int(0.5 * n0) and o.filter("fraud = 0").count() == n0
    with pytest.raises(RatioAlreadyReached):
        under_sample(u.unionByName(u.filter("fraud = 1")), "fraud", "id")


def test_smote_enn(spark):
    emb = table(spark, SF01, "embeddings").select(
        "vec_id", (F.col("label") == 0).cast("int").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    cols = [f"e{i}" for i in range(8)]
    n1 = emb.filter("y = 1").count()
    n0 = emb.filter("y = 0").count()
    mino, majo = (0, 1) if n0 < n1 else (1, 0)
    over = K.smote(emb, "vec_id", "y", cols)
    assert over.filter(F.col("y") == mino).count() == int(0.5 * max(n0, n1))
    assert over.filter(F.col("vec_id") < 0).count() == int(0.5 * max(n0, n1)) - min(n0, n1)
    cleaned = K.smote_enn(emb, "vec_id", "y", cols)
    assert 0 < cleaned.count() <= over.count()


@pytest.mark.parametrize("block", [2048, 5])
def test_knn_ties_go_to_the_lowest_id(spark, block, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QBLOCK", block)
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(12)], "id long, vec array<double>")
    got = {}
    for r in K.knn(df, df, 3, "id", "id", "vec", exclude_same_id=True).collect():
        got.setdefault(r["q_id"], []).append((r["nn_rank"], r["r_id"]))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i in range(12) if i != q][:3] for q in range(12)}


def test_split_and_under_sample_take_the_smallest_hashes(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"), F.lit("x").alias("wide"))
    order = [r["k"] for r in df.orderBy(F.xxhash64("k", F.lit(7)), "k").collect()]
    s = split_train_test(df, "k", 0.301, 7)
    assert s.columns == ["k", "y", "wide", "is_test"]
    assert {r["k"] for r in s.filter("is_test").collect()} == set(order[:301])
    assert "Sort" not in s._jdf.queryExecution().executedPlan().toString()
    u = {r["k"] for r in under_sample(df, "y", "k", seed=7).collect()}
    assert u == {k for k in range(0, 1000, 10)} | set([k for k in order if k % 10][:200])


@pytest.mark.parametrize("group", [65536, 1600])
def test_vectors_move_with_groups_and_not_with_the_cells_of_each_query(spark, group, monkeypatch):
    """High-dimensional noise, where every query needs nearly every cell: exact, for a far origin and copies too."""
    monkeypatch.setattr(K, "BLOCK", 40)
    monkeypatch.setattr(K, "GROUP", group)
    monkeypatch.setattr(K, "QBLOCK", min(K.QBLOCK, group))
    moved = []
    tiles = K._tiles
    monkeypatch.setattr(K, "_tiles", lambda rows, *a: moved.append(rows.count()) or tiles(rows, *a))
    rng = np.random.default_rng(5)
    X = rng.normal(size=(1600, 12)) + 2.4e6
    X[:40] = X[0]
    X[40, 0] += 1e7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "id long, v array<double>").repartition(3)
    report, got = {}, {}
    for r in K.knn(df, df, 3, "id", "id", "v", exclude_same_id=True, carry=["__vec"], report=report).collect():
        got.setdefault(r["q_id"], []).append((r["nn_rank"], r["r_id"]))
        assert np.array_equal(X[r["r_id"]], r["__vec"])
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == _brute(X, range(1600), X, range(1600), 3, True)
    assert report["visited"] > 0.3      # little can be left out
    assert sum(moved) < 1600 * 40 / 2      # each query with each of its cells would be 1600 x 40


def test_knn_with_text_ids_and_vectors_without_numbers(spark):
    X = np.random.default_rng(3).normal(size=(60, 2)).round(1)
    rows = [(f"k{i:02d}", v.tolist()) for i, v in enumerate(X)] + [("nan", [float("nan"), 0.0]), ("inf", [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = {}
    for r in K.knn(df, df, 3, "id", "id", "v", exclude_same_id=True).collect():
        got.setdefault(r["q_id"], []).append((r["nn_rank"], r["r_id"]))
    ids = [r[0] for r in rows[:60]]
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == _brute(X, ids, X, ids, 3, True)


@pytest.mark.parametrize("one_table", [True, False])
def test_what_is_moved_and_stored_is_bounded(spark, monkeypatch, one_table):
    """Batches and waves give the exact neighbours; none moves more than its share, and only the result stays on disk."""
    import os
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 3))
    X[200:260] = X[200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "id long, v array<double>").repartition(3)
    q = df if one_table else df.filter("id % 3 = 0")
    for name, value in (("BLOCK", 25), ("QBLOCK", 256), ("GROUP", 60), ("PART", 200), ("MOVED", 88 * 900)):
        monkeypatch.setattr(K, name, value)
    moved, tiles = [], K._tiles
    monkeypatch.setattr(K, "_tiles", lambda rows, *a: moved.append(rows.count()) or tiles(rows, *a))
    report, got = {}, {}
    for r in K.knn(q, df, 4, "id", "id", "v", exclude_same_id=True, report=report).collect():
        got.setdefault(r["q_id"], []).append((r["nn_rank"], r["r_id"]))
    ids = range(600) if one_table else range(0, 600, 3)
    assert {i: [r for _, r in sorted(v)] for i, v in got.items()} == _brute(X, range(600), X[list(ids)], ids, 4, True)
    assert report["waves"] > 2 and max(moved) < sum(moved) / 2 and max(moved) < 1800
    assert os.listdir(report["folder"].removeprefix("file:")) == ["top"]


def test_smote_enn_stores_only_its_result(spark, monkeypatch):
    import os
    rng = np.random.default_rng(6)
    X = rng.normal(size=(600, 3))
    df = spark.createDataFrame([(i, int(i % 6 == 0), *map(float, v)) for i, v in enumerate(X)], "id long, y int, a double, b double, c double").repartition(3)
    rows = lambda: sorted(tuple(r) for r in K.smote_enn(df, "id", "y", ["a", "b", "c"]).collect())
    want, folders, scratch = rows(), [], K.scratch_dir
    monkeypatch.setattr(K, "scratch_dir", lambda s, name: folders.append(scratch(s, name)) or folders[-1])
    monkeypatch.setattr(K, "MOVED", 20_000)
    assert rows() == want and 300 < len(want) < 750
    left = {f.rsplit("/", 1)[1].rsplit("-", 1)[0]: os.listdir(f.removeprefix("file:")) for f in folders if os.path.isdir(f.removeprefix("file:"))}
    assert left == {"smote-enn": ["rows"]}
    # every synthetic row lies between two minority rows
    over = {r["id"]: np.array([r["a"], r["b"], r["c"]]) for r in K.smote(df, "id", "y", ["a", "b", "c"]).collect()}
    minority = X[::6]
    near = [[j for _, j in sorted((np.linalg.norm(x - z), j) for j, z in enumerate(minority))[1:6]] for x in minority]
    new = [v for i, v in over.items() if i < 0]
    assert len(new) == 150
    for v in new:
        assert any(abs(np.linalg.norm(v - x) + np.linalg.norm(v - minority[j]) - np.linalg.norm(x - minority[j])) < 1e-9 for x, js in zip(minority, near) for j in js)


def test_smote_enn_of_many_computed_columns(spark):
    """Conditions on vectors of computed columns are not multiplied by the planner."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, int(i % 6 == 0), v.tolist()) for i, v in enumerate(rng.normal(size=(60, 40)))], "id long, y int, v array<float>")
    cols = [f"e{i}" for i in range(40)]
    df = df.select("id", "y", *[F.col("v")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    assert 0 < K.smote_enn(df, "id", "y", cols).count() <= 75
    assert spark.conf.get(K.CONSTRAINTS) == "true"
