import pytest
from pyspark.sql import functions as F

from fraudframe.operators.encode import dense_index, encode, encoded_field_names, split_bad_rows
from fraudframe.operators.profile import TableProfile, label_candidates, profile_frame, profile_table
from fraudframe.operators.validate import numeric_field_count, validate_plan
from fraudframe.plans import spec as S
from fraudframe.sources.testdata import event_transactions
from tests.conftest import SF001

# The reference's test table, restated as a profile (names and types only;
# its 11,915 rows live in a MySQL dump, the checks need only the profile).
FIELDS = [("id", "int"), ("card_number", "varchar"), ("transaction_type", "int"), ("timestamp", "datetime"),
          ("amount", "int"), ("currency_name", "varchar"), ("response_code", "int"),
          ("country_name", "varchar"), ("vendor_code", "varchar"), ("fraud", "int")]
APPLICABLE = {"card_number": ["float"], "vendor_code": ["float", "int"]}


def fixture_profile():
    fields = [{"name": n, "type": t, "applicable": APPLICABLE.get(n, []), "n_null": 0} for n, t in FIELDS]
    return TableProfile(fields, 11915, "id", [{"name": "fraud", "fraud_number": 601, "no_fraud_number": 11314}])


FULL = {"card_number": "float", "timestamp": "julian", "currency_name": "label_encoder",
        "fraud": "fraud_type", "country_name": "omit", "vendor_code": "label_encoder"}


def plan(enc, features=None, time_base="timestamp"):
    return S.EncodingPlan("transactions", time_base, enc, S.FeatureParams.from_dict(features))


def test_numeric_fields():
    assert numeric_field_count(fixture_profile()) == 5


def test_full_encoding_label():
    p = validate_plan(fixture_profile(), plan(FULL, {"chosen_feature_field": "amount", "intervals": [3, 7]}))
    assert p.label == "fraud"


def test_encoded_names():
    names = encoded_field_names([n for n, _ in FIELDS], {"card_number": "label_encoder",
                                                         "transaction_type": "omit", "fraud": "fraud_type"}, "id")
    assert len(names) == 8 and names[-1] == "fraud"


def test_partial_encoding_rejected_by_stricter_rule():
    enc = {"card_number": "label_encoder", "transaction_type": "omit", "fraud": "fraud_type"}
    with pytest.raises(S.UnencodedColumn):
        validate_plan(fixture_profile(), plan(enc))


@pytest.mark.parametrize("enc,err", [
    ({**FULL, "transaction_type": "fraud_type"}, S.NotALabelCandidate),
    ({k: v for k, v in FULL.items() if k != "fraud"}, S.NoLabelField),
    ({**FULL, "vendor_code": "double"}, S.EncodingNotApplicable),
    ({**FULL, "vendor_code": "julian"}, S.EncodingNotApplicable),
    ({**FULL, "timestamp": "omit"}, S.EncodingNotApplicable),
    ({**FULL, "nope": "omit"}, S.FieldNotInTable),
])
def test_encoding_errors(enc, err):
    with pytest.raises(err):
        validate_plan(fixture_profile(), plan(enc))


def test_two_labels():
    prof = fixture_profile()
    prof.label_candidates.append({"name": "transaction_type", "fraud_number": 1, "no_fraud_number": 1})
    with pytest.raises(S.TooManyLabelFields):
        validate_plan(prof, plan({**FULL, "transaction_type": "fraud_type"}))


@pytest.mark.parametrize("features", [
    {"chosen_feature_field": "amount"},
    {"chosen_feature_field": "amount", "intervals": []},
    {"chosen_feature_field": "currency_name", "intervals": [3, 7]},
    {"chosen_feature_field": "amount", "intervals": [0]},
    {"intervals": [3]},
])
def test_feature_errors(features):
    with pytest.raises(S.FeatureParametersNotApplicable):
        validate_plan(fixture_profile(), plan(FULL, features))


def test_feature_field_omitted():
    with pytest.raises(S.FeatureParametersNotApplicable):
        validate_plan(fixture_profile(), plan({**FULL, "amount": "omit"},
                                              {"chosen_feature_field": "amount", "intervals": [2, 5]}))


def test_time_base_not_datetime():
    with pytest.raises(S.TimeBaseNotDatetime):
        validate_plan(fixture_profile(), plan(FULL, time_base="amount"))


def test_plan_exists():
    p = plan(FULL)
    with pytest.raises(S.PlanExists):
        validate_plan(fixture_profile(), plan(FULL), existing=[p])


def test_job_validation():
    with pytest.raises(S.JobNotValid):
        S.TrainJob("p", test_size=1.0).validate()
    with pytest.raises(S.JobNotValid):
        S.TrainJob("p", model=99).validate()
    S.TrainJob("p").validate()


def test_profile_events(spark):
    tx = event_transactions(spark, SF001)
    prof = profile_table(tx, "id")
    assert prof.primary_key == "id"
    assert [c["name"] for c in prof.label_candidates] == ["fraud"]
    assert prof.field("vendor_code")["applicable"] == ["float", "int"]
    assert prof.field("card_number")["applicable"] == ["float", "int"]
    assert prof.field("event_type")["applicable"] == []


def test_profile_edge_values(spark):
    df = spark.createDataFrame(
        [("1", 1.0, "2147483647", "12", True), ("0", 0.0, "2147483648", "-3", False), ("1", 1.0, "0002147483647", "4", True)],
        "s string, d double, big string, signed string, b boolean")
    rows = {r["name"]: r for r in profile_frame(df).collect()}
    assert rows["s"]["is_label_candidate"] and rows["d"]["is_label_candidate"] and rows["b"]["is_label_candidate"]
    assert rows["big"]["all_digits"] and not rows["big"]["fits_int"]
    assert not rows["signed"]["all_digits"]
    assert label_candidates(profile_frame(df)).count() == 3


def test_dense_index_matches_rank(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).cast("string").alias("v")).repartition(7)
    got = {r["v"]: r["code"] for r in dense_index(df, "v").collect()}
    want = {v: i for i, v in enumerate(sorted(got))}
    assert got == want


def test_encode_events(spark):
    tx = event_transactions(spark, SF001)
    p = S.EncodingPlan("events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int",
                                        "event_type": "omit", "fraud": "fraud_type"}, entity="card_number")
    out, model = encode(tx, p)
    assert out.columns == ["id", "_entity", "_us", "card_number", "ts", "amount", "vendor_code", "fraud"]
    assert all(t == "double" for c, t in out.dtypes[3:])
    assert out.count() == tx.count()


def test_label_encoder_unseen(spark):
    tx = event_transactions(spark, SF001)
    p = S.EncodingPlan("events", "ts", {"event_type": "label_encoder", "fraud": "fraud_type", "ts": "julian",
                                        "card_number": "label_encoder", "vendor_code": "omit"})
    _, model = encode(tx, p)
    new = tx.limit(3).withColumn("event_type", F.lit("never-seen"))
    with pytest.raises(Exception):
        model.transform(new).collect()
    kept = model.transform(new, handle_unseen="keep").select("event_type").distinct().collect()
    assert kept[0][0] == 5.0


def test_split_bad_rows(spark):
    df = spark.createDataFrame([("1", "2.5", "2024-01-01 00:00:00"), ("x", "3", None)], "a string, b string, t string")
    out = {r["a"]: r["reject_reason"] for r in split_bad_rows(df, {"a": "int", "b": "float", "t": "datetime"}).collect()}
    assert out == {"1": None, "x": "a: not int"}
