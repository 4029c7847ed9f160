"""The whole training job (survey H10): encode -> look-back features ->
split -> resample (training part only) -> scale -> select -> fit -> score
the test part -> metrics, returning a ``FittedBundle`` that scores new rows
with exactly the same steps.

Sampling happens before scaling, as in the original job, so resampling
distances are on unscaled columns.
"""
from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudframe.operators.classify import make_classifier, with_probabilities
from fraudframe.operators.encode import ENTITY, US, EncoderModel, fit_encoder
from fraudframe.operators.lookback import LookbackSpec, add_lookback_features
from fraudframe.operators.metrics import binary_metrics, score_auc
from fraudframe.operators.resample import over_sample, split_train_test, under_sample
from fraudframe.operators.scale import ScalerModel, fit_scaler
from fraudframe.operators.select import SelectorModel, fit_selector
from fraudframe.operators.profile import profile_table
from fraudframe.operators.validate import validate_plan
from fraudframe.plans.spec import MODELS, SAMPLERS, SCALERS, SELECTORS, EncodingPlan, PlanError, TrainJob
from fraudframe.sources.replay import scratch_dir, stored


@dataclass
class FittedBundle:
    """Everything needed to score: encoder, feature spec, scaler, selector,
    model, and the feature column order."""

    plan: EncodingPlan
    job: TrainJob
    encoder: EncoderModel
    lookback: LookbackSpec | None
    feature_columns: list[str]
    scaler: ScalerModel
    selector: SelectorModel
    model: object
    metrics: DataFrame | None = None
    info: dict = field(default_factory=dict)

    def features(self, encoded: DataFrame) -> DataFrame:
        """Encoded rows -> assembled, scaled, selected ``features`` vector."""
        scaled = self.scaler.transform(encoded)
        assembled = VectorAssembler(inputCols=self.feature_columns, outputCol="features",
                                    handleInvalid="error").transform(scaled)
        return self.selector.transform(assembled)

    def score(self, feature_rows: DataFrame) -> DataFrame:
        """Rows that already carry the look-back features -> score columns."""
        return with_probabilities(self.model.transform(self.features(feature_rows)))

    def save(self, path: str) -> None:
        """Encoder dictionaries and Spark ML stages with their writers; the
        kNN training set as parquet; everything else in a JSON sidecar."""
        import numpy as np
        spark = _session()
        self.encoder.save(os.path.join(path, "encoder"))
        model_kind = type(self.model).__name__
        extra: dict = {}
        if hasattr(self.model, "write"):
            self.model.write().overwrite().save(os.path.join(path, "model"))
        elif model_kind == "LinearDiscriminantModel":
            extra["lda"] = {"weights": list(map(float, self.model.weights)), "bias": self.model.bias}
        elif model_kind == "BoostedTreesModel":
            extra["boosted"] = self.model.to_json()
        elif model_kind == "DeepTreesModel":
            self.model.save(spark, os.path.join(path, "deep_trees"))
            extra["deep_trees"] = {"edges": [e.tolist() for e in self.model.edges], "features": self.model.features,
                                   "pieces": self.model.pieces is not None}
        elif model_kind == "KNNModel":
            self.model.train.write.mode("overwrite").parquet(os.path.join(path, "knn_train"))
            extra["knn"] = {"k": self.model.k, "label": self.model.label, "features": self.model.features,
                            "key": self.model.key}
        sel = self.selector
        if sel.kind == "pca_95":
            for i, st in enumerate(sel.stages):
                st.write().overwrite().save(os.path.join(path, f"selector_{i}"))
        extra["selector"] = {"kind": sel.kind, "n_out": sel.n_out, "indices": sel.indices,
                             "matrix": None if sel.matrix is None else np.asarray(sel.matrix).tolist()}
        meta = {"plan": json.loads(self.plan.to_json()), "job": json.loads(self.job.to_json()),
                "feature_columns": self.feature_columns, "model_kind": model_kind,
                "scaler": {"kind": self.scaler.kind, "columns": self.scaler.columns,
                           "params": {c: list(v) for c, v in self.scaler.params.items()}},
                "lookback": None if self.lookback is None else {
                    "entity": self.lookback.entity, "time": self.lookback.time, "value": self.lookback.value,
                    "intervals": list(self.lookback.intervals), "label": self.lookback.label,
                    "profile": self.lookback.profile, "tie": self.lookback.tie},
                "info": self.info, **extra}
        spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "bundle"))

    @staticmethod
    def load(spark, path: str) -> "FittedBundle":
        import numpy as np
        from pyspark.ml.feature import PCAModel, StandardScalerModel, VectorSlicer
        from fraudframe.operators.boost import BoostedTreesModel
        from fraudframe.operators.classify import LinearDiscriminantModel
        from fraudframe.operators.deep_trees import DeepTreesModel
        from fraudframe.operators.knn import KNNModel
        from fraudframe.plans.spec import FeatureParams
        meta = json.loads(spark.read.text(os.path.join(path, "bundle")).first()[0])
        p, j = meta["plan"], meta["job"]
        plan = EncodingPlan(p["table"], p["time_base"], p["encoding"], FeatureParams.from_dict(p["features"]),
                            p["entity"], p["key"], p.get("profile", "canonical"))
        job = TrainJob(**j)
        encoder = EncoderModel.load(spark, os.path.join(path, "encoder"))
        lb = meta["lookback"]
        spec = None if lb is None else LookbackSpec(lb["entity"], lb["time"], lb["value"], tuple(lb["intervals"]),
                                                    lb["label"], lb["profile"], lb.get("tie"))
        sc = meta["scaler"]
        scaler = ScalerModel(sc["kind"], sc["columns"], {c: tuple(v) for c, v in sc["params"].items()})
        sm = meta["selector"]
        if sm["kind"] == "pca_95":
            stages = [StandardScalerModel.load(os.path.join(path, "selector_0")),
                      PCAModel.load(os.path.join(path, "selector_1")),
                      VectorSlicer.load(os.path.join(path, "selector_2"))]
            selector = SelectorModel("pca_95", stages, n_out=sm["n_out"])
        elif sm["kind"] == "truncated_svd_2":
            selector = SelectorModel(sm["kind"], matrix=np.asarray(sm["matrix"]), n_out=sm["n_out"])
        else:
            slicer = VectorSlicer(inputCol="__raw", outputCol="features", indices=sm["indices"])
            selector = SelectorModel(sm["kind"], [slicer], indices=sm["indices"], n_out=sm["n_out"])
        kind = meta["model_kind"]
        if kind == "LinearDiscriminantModel":
            model = LinearDiscriminantModel(np.asarray(meta["lda"]["weights"]), meta["lda"]["bias"])
        elif kind == "BoostedTreesModel":
            model = BoostedTreesModel.from_json(meta["boosted"])
        elif kind == "DeepTreesModel":
            model = DeepTreesModel.load(spark, os.path.join(path, "deep_trees"), **meta["deep_trees"])
        elif kind == "KNNModel":
            kn = meta["knn"]
            model = KNNModel(spark.read.parquet(os.path.join(path, "knn_train")), kn["k"], kn["label"],
                             kn["features"], kn.get("key"))
        else:
            import pyspark.ml.classification as C
            model = getattr(C, kind).load(os.path.join(path, "model"))
        return FittedBundle(plan, job, encoder, spec, meta["feature_columns"], scaler, selector, model,
                            info=meta["info"])


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def model_features(columns: list[str], label: str, drop: tuple[str, ...] = ()) -> list[str]:
    skip = {label, ENTITY, US, *drop}
    return [c for c in columns if c not in skip]


def validate_input(raw: DataFrame, plan: EncodingPlan) -> None:
    """The plan against the profile of the labelled rows; no row, labelled or
    not, may lack its entity, time or key."""
    validate_plan(profile_table(raw.filter(F.col(plan.label).isNotNull()), plan.key), plan)
    needed = list(dict.fromkeys([plan.entity, plan.time_base, plan.key]))
    for c, n in raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first().asDict().items():
        if n:
            raise PlanError(f"column {c!r} is NULL in {n} rows")


def fit_job(raw: DataFrame, plan: EncodingPlan, job: TrainJob, rfecv_args: dict | None = None, store=None,
            input_id: str | None = None, validate: bool = True) -> FittedBundle:
    """With a ``store`` and the ``input_id`` of the data, jobs of one plan share the stored feature
    table, and plans of one encoding the stored dictionaries and encoded table; otherwise the feature table is
    written to a scratch folder of its own."""
    job.validate()
    label = plan.label
    if label is None:
        raise ValueError("plan has no single fraud_type column")
    if plan.key is None:
        raise ValueError("plan has no key column, which split and resampling order rows by")
    if store is not None and input_id is None:
        raise ValueError("a store needs the input's id")
    if validate:
        validate_input(raw, plan)
    if store is None:
        encoder = fit_encoder(raw, plan)
        encoded = encoder.transform(raw)
    else:       # shared by all plans that differ in their look-back features only
        encoder = store.encoder(plan, input_id, lambda: fit_encoder(raw, plan))
        encoded = store.derived("encoded", plan.encoding_json(), input_id, lambda: encoder.transform(raw))
    spec = None
    data = encoded
    if plan.features is not None:
        spec = LookbackSpec(ENTITY, US, plan.features.chosen_feature_field, tuple(plan.features.intervals),
                            label=label, profile=plan.profile, tie=plan.key)
        data = add_lookback_features(encoded, spec)
    key = plan.key
    # rows without a label (appended by scoring) are history only
    labelled = data.withColumn(label, F.col(label).cast("int")).filter(F.col(label).isNotNull())
    # the feature table is written once as parquet and every later pass (split,
    # resampling, scaler, selector, model) reads the columns it needs from there
    if store is not None:
        data = store.derived("features", plan.to_json(), input_id, lambda: labelled)
    else:
        path = scratch_dir(raw.sparkSession, "features")
        data = stored(labelled, path)
    data = split_train_test(data, key, job.test_size, job.seed)
    train, test = data.filter(~F.col("is_test")).drop("is_test"), data.filter("is_test").drop("is_test")
    sampler = SAMPLERS[job.sampler]
    if sampler == "random_under_sampler":
        train = under_sample(train, label, key, seed=job.seed)
    elif sampler == "random_over_sampler":
        train = over_sample(train, label, key, seed=job.seed)
    else:
        from fraudframe.operators.knn import smote_enn
        cols = model_features(train.columns, label, (key,))
        train = smote_enn(train, key, label, cols, seed=job.seed)
    feats = model_features(encoded.columns if spec is None else data.columns, label, (key, "is_test"))
    scaler = fit_scaler(train, feats, SCALERS[job.scaler])
    assembled = VectorAssembler(inputCols=feats, outputCol="features").transform(scaler.transform(train))
    selector = fit_selector(SELECTORS[job.selector], assembled, key, label, **(rfecv_args or {}))
    selected = selector.transform(assembled).select(key, label, "features")
    n = selected.count()
    model = make_classifier(job.model, n, job.seed, label=label, key=key).fit(selected)
    bundle = FittedBundle(plan, job, encoder, spec, feats, scaler, selector, model,
                          info={"model": MODELS[job.model], "train_rows": n, "selected": selector.n_out})
    scored = bundle.score(test)
    bundle.metrics = binary_metrics(scored, label, "prediction")
    bundle.info["score_auc"] = score_auc(scored, label)
    return bundle
