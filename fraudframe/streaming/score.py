"""Scoring new transactions with every registered model (survey J1, J2, J6).

raw stream -> contract check (rejects go to their own sink, ``start_rejects``) -> encode with
the stored dictionaries (stream-static join) -> keyed look-back state ->
``foreachBatch``: every registered model scores the micro-batch, results are
written long form (one row per transaction and model) under the batch id,
so a re-run of a batch after a failure overwrites instead of duplicating.
"""
from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudframe.operators.encode import ENTITY, US, EncoderModel, split_bad_rows
from fraudframe.operators.lookback import LookbackSpec
from fraudframe.streaming.lookback_state import stream_lookback

SCORE_COLUMNS = ["model_id", "prediction", "positive_probability", "negative_probability"]


@dataclass
class ModelRegistry:
    """The active model set: add, remove, list (J6)."""

    models: dict[str, object] = field(default_factory=dict)

    def register(self, model_id: str, bundle) -> None:
        self.models[str(model_id)] = bundle

    def remove(self, model_id: str) -> None:
        self.models.pop(str(model_id), None)

    def ids(self) -> list[str]:
        return sorted(self.models)

    @staticmethod
    def from_store(store) -> ModelRegistry:
        """Every stored estimator, by its id (one row a model is read)."""
        from fraudframe.plans.fit_job import FittedBundle
        out = ModelRegistry()
        for row in store.estimators().select("estimator_id", "path").collect():
            out.register(row["estimator_id"], FittedBundle.load(store.spark, row["path"]))
        return out

    def by_steps(self) -> list[ModelRegistry]:
        """One registry for the models of each encoding and look-back spec; encoders that encode
        alike are one, also if each model was loaded with its own."""
        groups: dict[tuple, ModelRegistry] = {}
        for mid in self.ids():
            b = self.models[mid]
            groups.setdefault((b.encoder.content_id(), b.lookback), ModelRegistry()).register(mid, b)
        return list(groups.values())


def score_all(rows: DataFrame, registry: ModelRegistry, key: str) -> DataFrame:
    """Long form: (key, model_id, prediction, positive_probability,
    negative_probability) for every row and every registered model."""
    parts = []
    for mid in registry.ids():
        scored = registry.models[mid].score(rows)
        parts.append(scored.select(key, F.lit(mid).alias("model_id"), *SCORE_COLUMNS[1:]))
    if not parts:
        raise ValueError("no registered model")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_map(long_scores: DataFrame, key: str) -> DataFrame:
    """Wide form: one row per transaction, a map model_id -> scores."""
    return long_scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(
        "model_id", F.struct("prediction", "positive_probability", "negative_probability")))).alias("scores"))


def start_scoring(raw_stream: DataFrame, encoder: EncoderModel, spec: LookbackSpec, registry: ModelRegistry,
                  out_path: str, checkpoint: str, contract: dict[str, str] | None = None,
                  lateness: str = "1 day", trigger: dict | None = None, handle_unseen: str = "keep",
                  seed: str | None = None, history_path: str | None = None):
    """Start the scoring query; returns the ``StreamingQuery``.  Rows that fail
    the contract are not scored; ``start_rejects`` writes them with the reason.
    ``seed`` is a ``write_seed`` folder of the stored, encoded history;
    ``history_path`` takes the scored rows with their features, label NULL, by batch."""
    key = encoder.plan.key
    checked = split_bad_rows(raw_stream, contract) if contract else raw_stream.withColumn(
        "reject_reason", F.lit(None).cast("string"))
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    encoded = encoder.transform(good, handle_unseen=handle_unseen, require_label=False)
    feats = stream_lookback(encoded, spec, key, lateness=lateness, seed=seed)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # every model reads the batch: without this the state would be run once a model
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = score_all(batch, registry, key)
            scored.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))
            if history_path is not None:
                label = encoder.plan.label
                past = batch if label is None else batch.withColumn(label, F.lit(None).cast("double"))
                past.write.mode("overwrite").parquet(os.path.join(history_path, f"batch_id={batch_id}"))
        finally:
            batch.unpersist()

    w = feats.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def start_every_model(raw_stream: DataFrame, registry: ModelRegistry, out_root: str, checkpoint_root: str,
                      seeds: dict[str, str] | None = None, **options) -> list:
    """Every model with its own encoding plan and features: models that share an
    encoder and a spec share a query, the others get one each.  A query's
    folders, and its seed in ``seeds``, are named by its first model's id, so a
    query goes on where it was as long as that model stays.  Returns the queries."""
    started = []
    for group in registry.by_steps():
        name = group.ids()[0]
        bundle = group.models[name]
        if bundle.lookback is None:
            raise ValueError(f"model {name} has no look-back features to stream")
        started.append(start_scoring(raw_stream, bundle.encoder, bundle.lookback, group, os.path.join(out_root, f"steps={name}"),
                                     os.path.join(checkpoint_root, name), seed=(seeds or {}).get(name), **options))
    return started


def start_rejects(raw_stream: DataFrame, contract: dict[str, str], out_path: str, checkpoint: str,
                  trigger: dict | None = None):
    """Start the query that appends every row failing the contract, with its
    ``reject_reason`` (the field's name and what is wrong), to a parquet table."""
    bad = split_bad_rows(raw_stream, contract).filter(F.col("reject_reason").isNotNull())
    w = (bad.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def stream_source(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def feature_sink(feats: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Append feature rows (label NULL) to a parquet table (A10)."""
    w = (feats.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["ModelRegistry", "score_all", "score_map", "start_scoring", "start_every_model", "start_rejects", "stream_source", "feature_sink",
           "ENTITY", "US"]
