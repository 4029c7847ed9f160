import pytest
from pyspark.sql import functions as F

from fraudframe.operators.metrics import METRIC_COLUMNS
from fraudframe.plans.fit_job import fit_job
from fraudframe.plans.spec import EncodingPlan, FeatureParams, TrainJob
from fraudframe.sources.testdata import event_transactions
from tests.conftest import SF001, SF01

PLAN = EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int",
                                     "event_type": "omit", "fraud": "fraud_type"},
                    FeatureParams("amount", (3,)), entity="card_number", key="id")


@pytest.mark.parametrize("model,selector,scaler,sampler", [
    (1, 2, 1, 1), (2, 3, 2, 2), (5, 2, 4, 1), (4, 2, 7, 1), (3, 3, 3, 1)])
def test_fit_job_models(spark, model, selector, scaler, sampler):
    raw = event_transactions(spark, SF01)
    b = fit_job(raw, PLAN, TrainJob("p", model=model, selector=selector, scaler=scaler, sampler=sampler))
    m = b.metrics.first().asDict()
    assert set(m) == set(METRIC_COLUMNS)
    assert m["TP"] + m["FP"] + m["TN"] + m["FN"] == 2500
    assert -1 <= m["MCC"] <= 1
    scored = b.score(b.lookback and __import__("fraudframe.operators.lookback", fromlist=["x"])
                     .add_lookback_features(b.encoder.transform(raw.limit(20)), b.lookback))
    assert set(["prediction", "positive_probability", "negative_probability"]) <= set(scored.columns)
    probs = scored.select((F.col("positive_probability") + F.col("negative_probability")).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in probs)


def test_fit_job_rfecv_small(spark):
    raw = event_transactions(spark, SF001)
    plan = EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int",
                                         "event_type": "omit", "fraud": "fraud_type"}, entity="card_number")
    b = fit_job(raw, plan, TrainJob("p", model=5, selector=1, scaler=1, sampler=1),
                rfecv_args={"folds": 2, "num_trees": 5})
    assert 1 <= b.selector.n_out <= 4


def test_fit_job_shares_stored_tables_and_validates(spark):
    from dataclasses import replace

    from fraudframe.plans.spec import EncodingNotApplicable, PlanError
    from fraudframe.plans.store import Store
    from fraudframe.sources.replay import scratch_dir
    raw = event_transactions(spark, SF001)
    raw = raw.withColumn("fraud", F.when(F.col("id") % 50 != 0, F.col("fraud")))  # rows that scoring appended
    store = Store(spark, scratch_dir(spark, "store"))
    bundles = [fit_job(raw, PLAN, TrainJob("p", model=m, selector=2, scaler=1, sampler=1), store=store, input_id="v1") for m in (1, 5)]
    labelled = raw.filter("fraud is not null").count()
    for b in bundles:
        m = b.metrics.first()
        assert m["TP"] + m["FP"] + m["TN"] + m["FN"] == -(-labelled // 4)
    import glob
    assert len(glob.glob(f"{store.root}/derived/*/*/_SUCCESS")) == 2
    # another interval: new features, the stored dictionaries and encoded table
    other = fit_job(raw, replace(PLAN, features=FeatureParams("amount", (2,))), TrainJob("p", model=5, selector=2, scaler=1, sampler=1), store=store, input_id="v1")
    assert other.lookback.intervals == (2,) and other.encoder.plan.features.intervals == (2,)
    assert {k: len(glob.glob(f"{store.root}/derived/{k}/*")) for k in ("encoded", "encoder", "features")} == {"encoded": 1, "encoder": 1, "features": 2}
    job = TrainJob("p", model=1, selector=2, scaler=1, sampler=1)
    with pytest.raises(ValueError):
        fit_job(raw, replace(PLAN, key=None), job)
    with pytest.raises(PlanError):
        fit_job(raw.withColumn("card_number", F.when(F.col("id") != 3, F.col("card_number"))), PLAN, job)
    with pytest.raises(EncodingNotApplicable):
        fit_job(raw, replace(PLAN, encoding=PLAN.encoding | {"event_type": "int"}), job)
