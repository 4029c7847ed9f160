"""Plans and jobs as plain dataclasses, with a canonical JSON form (sorted
keys) used for equality and for content-addressed reuse of derived tables."""
from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

# The encoding names a plan may use.
JULIAN = "julian"
LABEL_ENCODER = "label_encoder"
FLOAT = "float"
INT = "int"
FRAUD_TYPE = "fraud_type"
OMIT = "omit"
ENCODINGS = (JULIAN, LABEL_ENCODER, INT, FLOAT, FRAUD_TYPE, OMIT)


class PlanError(ValueError):
    """Base class of every plan / job validation error."""


class FieldNotInTable(PlanError):
    pass


class NoTimeBaseInTable(PlanError):
    pass


class TimeBaseNotDatetime(PlanError):
    pass


class PlanExists(PlanError):
    pass


class NotEnoughParameters(PlanError):
    pass


class NotALabelCandidate(PlanError):
    pass


class EncodingNotApplicable(PlanError):
    pass


class NoLabelField(PlanError):
    pass


class TooManyLabelFields(PlanError):
    pass


class FeatureParametersNotApplicable(PlanError):
    pass


class UnencodedColumn(PlanError):
    pass


class JobNotValid(PlanError):
    pass


def canonical_json(obj) -> str:
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), default=str)


def content_id(*parts) -> str:
    """Stable id of a parameter set (sha256 of its canonical JSON)."""
    return hashlib.sha256(canonical_json(list(parts)).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class FeatureParams:
    chosen_feature_field: str | None
    intervals: tuple[int, ...] | None

    @staticmethod
    def from_dict(d: dict | None) -> "FeatureParams | None":
        if d is None:
            return None
        iv = d.get("intervals")
        return FeatureParams(d.get("chosen_feature_field"), None if iv is None else tuple(iv))


@dataclass
class EncodingPlan:
    """What the user plans for a table: time base, one encoding per column
    (columns without one must be numeric), optional look-back features,
    the entity (card) column and the key column."""

    table: str
    time_base: str
    encoding: dict[str, str]
    features: FeatureParams | None = None
    entity: str = "card_number"
    key: str | None = "id"
    profile: str = "canonical"

    @property
    def label(self) -> str | None:
        labels = [c for c, e in self.encoding.items() if e == FRAUD_TYPE]
        return labels[0] if len(labels) == 1 else None

    def to_json(self) -> str:
        d = asdict(self)
        return canonical_json(d)

    def encoding_json(self) -> str:
        """What an encoded table depends on: everything but the look-back features."""
        d = asdict(self)
        return canonical_json({k: d[k] for k in ("table", "time_base", "encoding", "entity", "key")})

    def same_as(self, other: "EncodingPlan") -> bool:
        return (self.table, self.time_base, self.encoding, self.features) == \
            (other.table, other.time_base, other.encoding, other.features)


# Catalog codes of the samplers, scalers, selectors and models.
SAMPLERS = {1: "random_under_sampler", 2: "random_over_sampler", 3: "smote_enn"}
SCALERS = {1: "standard", 2: "min_max", 3: "max_abs", 4: "robust", 5: "quantile_normal",
           6: "quantile_uniform", 7: "normalizer"}
SELECTORS = {1: "rfecv_random_forest", 2: "pca_95", 3: "truncated_svd_2"}
MODELS = {1: "logistic_regression", 2: "linear_discriminant", 3: "k_nearest_neighbours", 4: "decision_tree",
          5: "gaussian_naive_bayes", 6: "random_forest", 7: "gbt_lightgbm_like", 8: "gbt_xgboost_like"}


@dataclass
class TrainJob:
    plan_id: str
    test_size: float = 0.25
    sampler: int = 1
    scaler: int = 1
    selector: int = 2
    model: int = 1
    seed: int = 0

    def validate(self) -> "TrainJob":
        if self.test_size is None or not (0.0 < float(self.test_size) < 1.0):
            raise JobNotValid(f"test_size must be strictly between 0 and 1, got {self.test_size!r}")
        for name, code, table in (("sampler", self.sampler, SAMPLERS), ("scaler", self.scaler, SCALERS),
                                  ("selector", self.selector, SELECTORS), ("model", self.model, MODELS)):
            if code not in table:
                raise JobNotValid(f"unknown {name} code {code!r}; known: {sorted(table)}")
        return self

    def to_json(self) -> str:
        return canonical_json(asdict(self))
