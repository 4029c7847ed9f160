import pytest

from fraudframe.plans.fit_job import fit_job
from fraudframe.plans.spec import EncodingPlan, FeatureParams, JobNotValid, PlanExists, TrainJob
from fraudframe.plans.store import Store
from fraudframe.sources.replay import scratch_dir
from fraudframe.sources.testdata import event_transactions
from tests.conftest import SF001

PLAN = EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int",
                                     "event_type": "omit", "fraud": "fraud_type"},
                    FeatureParams("amount", (3,)), entity="card_number", key="id")


def test_store_roundtrip(spark):
    st = Store(spark, scratch_dir(spark, "store"))
    pid = st.save_plan(PLAN)
    with pytest.raises(PlanExists):
        st.save_plan(PLAN)
    assert st.plan(pid).encoding == PLAN.encoding
    job = TrainJob(pid, model=5)
    jid = st.save_job(job)
    with pytest.raises(JobNotValid):
        st.save_job(job)
    raw = event_transactions(spark, SF001)
    calls = []

    def build():
        calls.append(1)
        return raw.select("id", "amount")

    a = st.derived("encoded", PLAN.to_json(), "events-sf0.001", build)
    b = st.derived("encoded", PLAN.to_json(), "events-sf0.001", build)
    assert a.count() == b.count() == raw.count() and len(calls) == 1
    bundle = fit_job(raw, PLAN, job)
    eid = st.save_estimator(jid, bundle)
    board = st.leaderboard().collect()
    assert len(board) == 1 and board[0]["estimator_id"] == eid
    assert st.metrics(eid).count() == 1 and st.estimators(jid).count() == 1


@pytest.mark.parametrize("model,selector", [(1, 2), (2, 3), (3, 2), (4, 3)])
def test_bundle_save_load_scores_the_same(spark, model, selector):
    import os
    from pyspark.sql import functions as F
    from fraudframe.operators.lookback import add_lookback_features
    from fraudframe.plans.fit_job import FittedBundle
    raw = event_transactions(spark, SF001)
    b = fit_job(raw, PLAN, TrainJob("p", model=model, selector=selector))
    path = os.path.join(scratch_dir(spark, "bundle"), "b")
    b.save(path)
    b2 = FittedBundle.load(spark, path)
    rows = add_lookback_features(b.encoder.transform(raw), b.lookback)
    s1 = {r["id"]: (r["prediction"], round(r["positive_probability"], 9))
          for r in b.score(rows).select("id", "prediction", "positive_probability").collect()}
    rows2 = add_lookback_features(b2.encoder.transform(raw), b2.lookback)
    s2 = {r["id"]: (r["prediction"], round(r["positive_probability"], 9))
          for r in b2.score(rows2).select("id", "prediction", "positive_probability").collect()}
    assert s1 == s2
