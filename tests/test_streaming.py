import math
import os

import pytest
from pyspark.sql import functions as F

from fraudframe.operators.lookback import LookbackSpec, add_lookback_features, feature_names
from fraudframe.sources.replay import scratch_dir, write_time_slices
from fraudframe.sources.testdata import event_transactions
from fraudframe.streaming.lookback_state import stream_lookback
from tests.conftest import SF001
from tests.edge_rows import SCHEMA, edge_rows


def _run_stream(spark, df, spec, key, slices):
    base = scratch_dir(spark, "test-stream")
    write_time_slices(df, spec.time, os.path.join(base, "src"), slices)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
    q = (stream_lookback(src, spec, key).writeStream.format("parquet")
         .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def _compare(stream_out, batch_out, names, key):
    s = {r[key]: [r[n] for n in names] for r in stream_out.collect()}
    b = {r[key]: [r[n] for n in names] for r in batch_out.collect()}
    assert set(s) == set(b)
    bad = [(k, i, s[k][i], b[k][i]) for k in b for i in range(len(names))
           if not math.isclose(s[k][i], b[k][i], rel_tol=1e-9, abs_tol=1e-9)]
    assert not bad, bad[:5]


@pytest.mark.parametrize("profile", ["canonical", "serve"])
def test_stream_equals_batch_events(spark, profile):
    tx = event_transactions(spark, SF001).select("id", "card_number", "ts", "amount", "fraud")
    spec = LookbackSpec("card_number", "ts", "amount", (3, 7), label="fraud", profile=profile)
    out = _run_stream(spark, tx, spec, "id", 4)
    assert out.columns[-1] == "fraud"
    _compare(out, add_lookback_features(tx, spec), feature_names("amount", (3, 7)), "id")


def test_stream_equals_batch_edge_rows(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    spec = LookbackSpec("card", "ts", "amount", (1, 3), label="fraud")
    out = _run_stream(spark, df, spec, "id", 5)
    _compare(out, add_lookback_features(df, spec), feature_names("amount", (1, 3)), "id")


@pytest.mark.parametrize("profile", ["canonical", "serve"])
def test_block_matches_row_formulas(profile):
    import numpy as np
    from fraudframe.streaming.lookback_state import features_block
    from tests.bruteforce import features_for
    rng = np.random.default_rng(3)
    D = 86_400_000_000
    us = np.sort(rng.integers(0, 9 * D, 60))
    us[10] = us[11]  # a tie
    v = rng.normal(50, 10, 60).round(2)
    t, tv = us[30:], v[30:]
    block = features_block(us, v, None, t, tv, (1, 3), profile)
    for i in range(len(t)):
        hi = int(np.searchsorted(us, t[i], side="left"))
        nb = int(us[hi - 1]) if hi else None
        row = features_for(us[:hi], v[:hi], nb, int(t[i]), float(tv[i]), (1, 3), profile)
        assert np.allclose(block[i], row, rtol=1e-9, atol=1e-9), (i, block[i], row)


def test_late_record_sees_its_window(spark):
    """A row arriving one micro-batch late (a few hours behind the newest
    time seen) still gets exactly the batch features for its own time."""
    from datetime import datetime, timedelta
    t0 = datetime(2024, 5, 1)
    rows = [(i, "c", t0 + timedelta(hours=5 * i), float(i % 7 + 1), 0) for i in range(40)]
    late_id = 25
    df = spark.createDataFrame(rows, SCHEMA)
    spec = LookbackSpec("card", "ts", "amount", (1, 3), label="fraud")
    base = scratch_dir(spark, "test-late")
    src_dir = os.path.join(base, "src")
    first = [r for r in rows if r[0] < 30 and r[0] != late_id]
    second = [r for r in rows if r[0] >= 30 or r[0] == late_id]
    for part in (first, second):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src_dir)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
    q = (stream_lookback(src, spec, "id").writeStream.format("parquet")
         .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    names = feature_names("amount", (1, 3))
    got = spark.read.parquet(os.path.join(base, "out")).filter(F.col("id") == late_id)
    want = add_lookback_features(df, spec).filter(F.col("id") == late_id)
    _compare(got, want, names, "id")


def _stream_parts(spark, parts, spec, **options):
    base = scratch_dir(spark, "test-parts")
    src_dir = os.path.join(base, "src")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src_dir)
    src = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
    q = (stream_lookback(src, spec, "id", **options).writeStream.format("parquet")
         .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def test_history_follows_the_watermark(spark):
    """Rows within a long lateness see their whole window, also when it lies
    far behind the entity's newest row and its previous row farther still."""
    from datetime import datetime, timedelta
    t0 = datetime(2024, 5, 1)
    rows = [(i, "c", t0 + timedelta(hours=5 * i), float(i % 7 + 1), 0) for i in range(40)]
    rows += [(100, "d", t0 - timedelta(days=40), 3.0, 0), (101, "d", t0 + timedelta(days=7), 5.0, 0),
             (102, "d", t0 + timedelta(days=4), 4.0, 0)]
    parts = [[r for r in rows if r[0] < 30 and r[0] != 10 or r[0] == 100], [r for r in rows if 30 <= r[0] < 35 or r[0] == 101],
             [r for r in rows if 35 <= r[0] < 40 or r[0] in (10, 102)]]
    spec = LookbackSpec("card", "ts", "amount", (3,), label="fraud")
    got = _stream_parts(spark, parts, spec, lateness="6 days")
    late = F.col("id").isin(10, 35, 39, 102)
    want = add_lookback_features(spark.createDataFrame(rows, SCHEMA), spec)
    _compare(got.filter(late), want.filter(late), feature_names("amount", (3,)), "id")


@pytest.mark.parametrize("profile", ["canonical", "serve"])
def test_seeded_stream_goes_on_from_the_stored_history(spark, profile):
    from datetime import datetime, timedelta

    from fraudframe.streaming.lookback_state import write_seed
    t0 = datetime(2024, 5, 1)
    rows = [(i, "ce"[i % 2], t0 + timedelta(hours=7 * i), float(i % 5 + 1), 0) for i in range(60)]
    rows += [(100, "d", t0 - timedelta(days=40), 3.0, 0), (101, "d", t0 + timedelta(days=15), 5.0, 0)]
    spec = LookbackSpec("card", "ts", "amount", (1, 3), label="fraud", profile=profile)
    old = [r for r in rows if r[0] < 40 or r[0] == 100]
    new = [r for r in rows if r not in old]
    seed = os.path.join(scratch_dir(spark, "test-seed"), "seed")
    write_seed(spark.createDataFrame(old, SCHEMA), spec, seed)
    assert spark.read.parquet(seed).count() < len(old)
    got = _stream_parts(spark, [new[:8], new[8:]], spec, seed=seed)
    want = add_lookback_features(spark.createDataFrame(rows, SCHEMA), spec).filter(F.col("id").isin([r[0] for r in new]))
    _compare(got, want, feature_names("amount", (1, 3)), "id")


def test_models_are_grouped_by_their_steps():
    from types import SimpleNamespace

    from fraudframe.streaming.score import ModelRegistry

    def enc(content):
        return SimpleNamespace(content_id=lambda: content)

    a, b = (LookbackSpec("card", "ts", "amount", k) for k in ((3,), (7,)))
    reg = ModelRegistry({"m1": SimpleNamespace(encoder=enc("x"), lookback=a), "m2": SimpleNamespace(encoder=enc("x"), lookback=b),
                         "m3": SimpleNamespace(encoder=enc("x"), lookback=a), "m4": SimpleNamespace(encoder=enc("y"), lookback=a)})
    assert [g.ids() for g in reg.by_steps()] == [["m1", "m3"], ["m2"], ["m4"]]


def test_loaded_models_of_one_plan_share_a_state(spark):
    """Three stored models, two of one plan: loaded again, they make two groups and two queries."""
    from dataclasses import replace

    from fraudframe.plans.fit_job import fit_job
    from fraudframe.plans.spec import EncodingPlan, FeatureParams, TrainJob
    from fraudframe.plans.store import Store
    from fraudframe.streaming.score import ModelRegistry, start_every_model
    tx = event_transactions(spark, SF001)
    plan = EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int", "event_type": "label_encoder",
                                         "fraud": "fraud_type"}, FeatureParams("amount", (3,)), entity="card_number", key="id")
    store = Store(spark, scratch_dir(spark, "test-groups"))
    for p, code in ((plan, 2), (plan, 5), (replace(plan, features=FeatureParams("amount", (2,))), 2)):
        job = TrainJob(p.to_json(), model=code, selector=2, scaler=1, sampler=1)
        store.save_estimator(store.save_job(job), fit_job(tx, p, job, store=store, input_id="v1"))
    reg = ModelRegistry.from_store(store)
    assert sorted(len(g.ids()) for g in reg.by_steps()) == [1, 2]
    base = scratch_dir(spark, "test-groups-stream")
    write_time_slices(tx, "ts", os.path.join(base, "src"), 1)
    src = spark.readStream.schema(tx.schema).parquet(os.path.join(base, "src"))
    queries = start_every_model(src, reg, os.path.join(base, "out"), os.path.join(base, "ck"))
    for q in queries:
        q.awaitTermination()
    assert len(queries) == 2
    out = spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(base, "out"))
    assert out.count() == 3 * tx.count() and out.select("model_id").distinct().count() == 3


def test_encoders_that_encode_alike_have_one_id(spark):
    from fraudframe.operators.encode import EncoderModel, fit_encoder
    from fraudframe.plans.spec import EncodingPlan, FeatureParams
    tx = event_transactions(spark, SF001)
    plan = EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int", "event_type": "label_encoder",
                                         "fraud": "fraud_type"}, FeatureParams("amount", (3,)), entity="card_number", key="id")
    a = fit_encoder(tx, plan)
    path = os.path.join(scratch_dir(spark, "test-encoder"), "e")
    a.save(path)
    assert EncoderModel.load(spark, path).content_id() == fit_encoder(tx.repartition(7), plan).content_id() == a.content_id()
    other = tx.withColumn("event_type", F.when(F.col("event_type") == "error", "failure").otherwise(F.col("event_type")))
    assert fit_encoder(other, plan).content_id() != a.content_id()


def test_rejects_are_written_with_their_reason(spark, tmp_path):
    from pyspark.sql import functions as F

    from fraudframe.streaming.score import start_rejects
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id long, amount string").write.parquet(src)
    stream = spark.readStream.schema("id long, amount string").parquet(src)
    start_rejects(stream, {"amount": "int"}, str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    bad = {r["id"]: r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert 1 not in bad and 2 in bad and all("amount" in x for x in bad.values())


def test_every_model_is_scored_and_its_rows_appended(spark):
    from fraudframe.plans.fit_job import fit_job
    from fraudframe.plans.spec import EncodingPlan, FeatureParams, TrainJob
    from fraudframe.streaming.lookback_state import write_seed
    from fraudframe.streaming.score import ModelRegistry, start_every_model
    tx = event_transactions(spark, SF001)
    plan = EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int", "event_type": "omit",
                                         "fraud": "fraud_type"}, FeatureParams("amount", (3,)), entity="card_number", key="id")
    bundle = fit_job(tx, plan, TrainJob("p", model=2, selector=2, scaler=1, sampler=1))
    old, new = tx.filter("id % 4 != 0"), tx.filter("id % 4 = 0")
    base = scratch_dir(spark, "test-score")
    write_time_slices(new, "ts", os.path.join(base, "src"), 2)
    seed = os.path.join(base, "seed")
    write_seed(bundle.encoder.transform(old), bundle.lookback, seed, lateness="40 days")
    src = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
    past = os.path.join(base, "past")
    for q in start_every_model(src, ModelRegistry({"m": bundle}), os.path.join(base, "out"), os.path.join(base, "ck"),
                               seeds={"m": seed}, history_path=past, lateness="40 days"):
        q.awaitTermination()
    n = new.count()
    assert spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(base, "out")).count() == n
    got = spark.read.parquet(past)
    assert got.count() == n and got.filter("fraud is not null").count() == 0
    # all old rows are in the seed, so the last slice's features are the batch's
    want = add_lookback_features(bundle.encoder.transform(tx), bundle.lookback)
    last = got.filter("batch_id = 1").select("id")
    _compare(got.join(last, "id"), want.join(last, "id"), feature_names("amount", (3,)), "id")


def test_late_rows_are_written_with_their_delay(spark):
    """Accepted plus late rows are the input; a batch that is run again changes nothing."""
    from datetime import datetime, timedelta

    from fraudframe.streaming.late import accepted_stream, late_rows, start_late_router
    t0 = datetime(2024, 5, 1)
    batches = [[(0, t0), (1, t0 + timedelta(days=3))], [(2, t0 + timedelta(days=2)), (3, t0 + timedelta(days=1, hours=23)), (4, t0 + timedelta(days=9))],
               [(5, t0 + timedelta(days=8)), (6, t0), (7, None)], [(8, t0 + timedelta(days=8, microseconds=-1)), (9, t0 + timedelta(days=20))]]
    base = scratch_dir(spark, "test-late")
    src, accepted, late, ck = (os.path.join(base, n) for n in ("src", "accepted", "late", "ck"))
    schema = "id long, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        start_late_router(spark.readStream.schema(schema).parquet(src), "ts", accepted, late, ck, "1 day").awaitTermination()
    got = {r["id"]: r["late_by_us"] for r in late_rows(spark, late).collect()}
    day = 86_400_000_000
    assert got == {3: day + 3_600_000_000, 6: 9 * day, 7: None, 8: day + 1}
    kept = spark.read.parquet(accepted)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 4, 5, 9]
    # the last micro-batch again, as after a failure before its commit
    for name in ("3", ".3.crc"):
        os.rename(os.path.join(ck, "commits", name), os.path.join(base, f"commit{name}"))
    start_late_router(spark.readStream.schema(schema).parquet(src), "ts", accepted, late, ck, "1 day").awaitTermination()
    assert spark.read.parquet(accepted).count() == 6 and late_rows(spark, late).count() == 4
    assert [f.name for f in accepted_stream(spark, accepted, kept.drop("batch_id").schema).schema.fields][:2] == ["id", "ts"]


@pytest.mark.parametrize("profile", ["canonical", "serve"])
def test_entities_of_a_bucket_are_worked_on_together(profile):
    """Several entities at once against one after the other, also where their times don't fit one axis."""
    import numpy as np
    from fraudframe.streaming.lookback_state import D, NEVER, features_block, features_of_cards
    rng = np.random.default_rng(1)
    for span in (20 * D, 1 << 60):
        card = np.sort(rng.integers(0, 9, 400))
        us = rng.integers(0, 20 * D, 400) // (D // 8) * (D // 8) + np.where(card % 2, span, 0)
        order = np.lexsort((us, card))
        us, v = us[order], rng.normal(size=400).round(1)
        newest = np.array([NEVER if c % 3 else int(us[card == c].min()) - D for c in range(9)])
        rows = np.sort(rng.choice(400, 150, replace=False))
        got = features_of_cards(card, us, v, newest, card[rows], us[rows], v[rows], (1, 3), profile)
        for c in range(9):
            own = rows[card[rows] == c]
            want = features_block(us[card == c], v[card == c], None if newest[c] == NEVER else int(newest[c]), us[own], v[own], (1, 3), profile)
            assert np.allclose(got[card[rows] == c], want, rtol=1e-12, atol=1e-12)


def test_calls_follow_the_buckets_and_not_the_entities(spark):
    df = spark.readStream.format("rate").load().selectExpr("value AS id", "CAST(value AS STRING) AS card", "timestamp AS ts", "CAST(value AS DOUBLE) AS amount")
    out = stream_lookback(df, LookbackSpec("card", "ts", "amount", (3,)), "id")
    grouping = next(x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroups" in x)
    assert "__bucket" in grouping
