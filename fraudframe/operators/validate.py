"""Plan validation (survey 2.B, B7): driver-side checks of an
``EncodingPlan`` against a ``TableProfile`` (the small result of the
one-pass profile).  Every rule raises its own ``PlanError`` subclass."""
from __future__ import annotations

from fraudframe.operators.profile import TableProfile
from fraudframe.plans.spec import (
    ENCODINGS, FLOAT, FRAUD_TYPE, INT, JULIAN, LABEL_ENCODER, OMIT,
    EncodingNotApplicable, EncodingPlan, FeatureParametersNotApplicable, FieldNotInTable,
    NoLabelField, NotALabelCandidate, NotEnoughParameters, NoTimeBaseInTable, PlanExists,
    TimeBaseNotDatetime, TooManyLabelFields, UnencodedColumn,
)

NUMERIC = ("int", "float")


def numeric_field_count(profile: TableProfile) -> int:
    return sum(1 for f in profile.fields if f["type"] in NUMERIC)


def check_time_base(profile: TableProfile, time_base: str) -> None:
    if profile.field(time_base) is None:
        raise FieldNotInTable(f"time base {time_base!r} is not a column")
    if not any(f["type"] == "datetime" for f in profile.fields):
        raise NoTimeBaseInTable("the table has no datetime column")
    if profile.field(time_base)["type"] != "datetime":
        raise TimeBaseNotDatetime(f"time base {time_base!r} is not a datetime column")


def check_encodings(profile: TableProfile, encoding: dict[str, str]) -> None:
    # the original's lenient parameter count: fields - numeric fields - 2
    if len(encoding) < len(profile.fields) - numeric_field_count(profile) - 2:
        raise NotEnoughParameters(f"only {len(encoding)} encoding parameters")
    candidates = {c["name"] for c in profile.label_candidates}
    for name, enc in encoding.items():
        f = profile.field(name)
        if f is None:
            raise FieldNotInTable(f"encoding names unknown column {name!r}")
        if enc == FRAUD_TYPE and name not in candidates:
            raise NotALabelCandidate(f"{name!r} is not a 0/1 column with both classes")
    for f in profile.fields:
        enc = encoding.get(f["name"])
        if enc is None:
            continue
        bad = (
            enc not in ENCODINGS
            or (enc == JULIAN and f["type"] != "datetime")
            or (enc == LABEL_ENCODER and f["type"] != "varchar")
            or (enc == INT and INT not in f["applicable"])
            or (enc == FLOAT and FLOAT not in f["applicable"])
        )
        if bad:
            raise EncodingNotApplicable(f"encoding {enc!r} does not apply to {f['name']!r} ({f['type']})")
    labels = [f["name"] for f in profile.fields if encoding.get(f["name"]) == FRAUD_TYPE]
    if not labels:
        raise NoLabelField("no fraud_type column")
    if len(labels) > 1:
        raise TooManyLabelFields(f"several fraud_type columns: {labels}")


def check_features(profile: TableProfile, encoding: dict[str, str], features) -> None:
    if features is None:
        return
    name, intervals = features.chosen_feature_field, features.intervals
    if name is None:
        raise FeatureParametersNotApplicable("chosen_feature_field is missing")
    if not intervals:
        raise FeatureParametersNotApplicable("intervals are missing or empty")
    for k in intervals:
        if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
            raise FeatureParametersNotApplicable(f"interval {k!r} is not a positive whole number of days")
    f = profile.field(name)
    if f is None:
        raise FeatureParametersNotApplicable(f"chosen field {name!r} is not a column")
    if f["type"] not in NUMERIC:
        raise FeatureParametersNotApplicable(f"chosen field {name!r} is not numeric ({f['type']})")
    if encoding.get(name) == OMIT:
        raise FeatureParametersNotApplicable(f"chosen field {name!r} is omitted")


def check_unencoded(profile: TableProfile, plan: EncodingPlan) -> None:
    """Our additions: every column without an encoding is numeric (it is
    passed through as a double), and the time base and entity are kept."""
    for f in profile.fields:
        if f["name"] in (plan.key, profile.primary_key):
            continue
        if f["name"] not in plan.encoding and f["type"] not in NUMERIC:
            raise UnencodedColumn(f"column {f['name']!r} ({f['type']}) has no encoding and is not numeric")
    for role, col in (("time base", plan.time_base), ("entity", plan.entity)):
        if plan.encoding.get(col) == OMIT:
            raise EncodingNotApplicable(f"the {role} {col!r} cannot be omitted")
    if plan.entity and profile.field(plan.entity) is None:
        raise FieldNotInTable(f"entity {plan.entity!r} is not a column")


def validate_plan(profile: TableProfile, plan: EncodingPlan, existing: list[EncodingPlan] = ()) -> EncodingPlan:
    check_time_base(profile, plan.time_base)
    for other in existing:
        if plan.same_as(other):
            raise PlanExists("an identical plan is already stored")
    check_encodings(profile, plan.encoding)
    check_features(profile, plan.encoding, plan.features)
    check_unencoded(profile, plan)
    return plan
