"""Bookkeeping and reuse (survey 2.K) in a shared folder.

* derived tables (encoded, feature tables) are content-addressed: the path
  is a hash of the builder's parameters and input id, so the same plan on
  the same input reads the stored table instead of recomputing it (K1, K2)
* plans, training jobs, estimators and metrics are small append-only
  parquet tables keyed by content ids (K3-K6); a duplicate is refused
* ``leaderboard`` joins jobs, estimators and metrics (K7)
"""
from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudframe.operators.encode import EncoderModel
from fraudframe.operators.metrics import METRIC_COLUMNS
from fraudframe.plans.spec import EncodingPlan, FeatureParams, PlanExists, JobNotValid, TrainJob, content_id


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _t(self, name: str) -> str:
        return os.path.join(self.root, "tables", name)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self._t(name)
        if _exists(self.spark, os.path.join(path, "_SUCCESS")) or _exists(self.spark, path):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self._t(name))

    # K1 / K2 ------------------------------------------------------------
    def derived(self, kind: str, params, input_id: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Read the stored table for (kind, params, input) or build and store it."""
        cid = content_id(kind, params, input_id)
        path = os.path.join(self.root, "derived", kind, cid)
        if not _exists(self.spark, os.path.join(path, "_SUCCESS")):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def encoder(self, plan: EncodingPlan, input_id: str, fit: Callable[[], EncoderModel]) -> EncoderModel:
        """The stored encoder of (encoding, input), fitted and stored if there is none; its
        plan is the given one, whose features may be others."""
        path = os.path.join(self.root, "derived", "encoder", content_id("encoder", plan.encoding_json(), input_id))
        if not _exists(self.spark, os.path.join(path, "meta", "_SUCCESS")):
            fit().save(path)
        return replace(EncoderModel.load(self.spark, path), plan=plan)

    # K3 -------------------------------------------------------------------
    PLAN_SCHEMA = "plan_id string, table_name string, plan string"

    def save_plan(self, plan: EncodingPlan) -> str:
        pid = content_id("plan", plan.to_json())
        if self.plans().filter(F.col("plan_id") == pid).limit(1).count():
            raise PlanExists(f"plan {pid} is already stored")
        self._append("plans", [(pid, plan.table, plan.to_json())], self.PLAN_SCHEMA)
        return pid

    def plans(self) -> DataFrame:
        return self._read("plans", self.PLAN_SCHEMA)

    def plan(self, plan_id: str) -> EncodingPlan:
        row = self.plans().filter(F.col("plan_id") == plan_id).first()
        if row is None:
            raise KeyError(plan_id)
        p = json.loads(row["plan"])
        return EncodingPlan(p["table"], p["time_base"], p["encoding"], FeatureParams.from_dict(p["features"]),
                            p["entity"], p["key"], p.get("profile", "canonical"))

    # K4 -------------------------------------------------------------------
    JOB_SCHEMA = "job_id string, plan_id string, job string"

    def save_job(self, job: TrainJob) -> str:
        job.validate()
        jid = content_id("job", job.to_json())
        new = self.spark.createDataFrame([(jid, job.plan_id, job.to_json())], self.JOB_SCHEMA)
        if new.join(self.jobs(), "job_id", "left_anti").count() == 0:
            raise JobNotValid(f"job {jid} is already stored")
        new.coalesce(1).write.mode("append").parquet(self._t("jobs"))
        return jid

    def jobs(self) -> DataFrame:
        return self._read("jobs", self.JOB_SCHEMA)

    # K6 / J7 --------------------------------------------------------------
    EST_SCHEMA = "estimator_id string, job_id string, model string, path string"

    def save_estimator(self, job_id: str, bundle) -> str:
        eid = content_id("estimator", job_id, bundle.info.get("model"))
        path = os.path.join(self.root, "estimators", eid)
        bundle.save(path)
        self._append("estimators", [(eid, job_id, bundle.info.get("model"), path)], self.EST_SCHEMA)
        if bundle.metrics is not None:
            self.save_metrics(eid, bundle.metrics)
        return eid

    def estimators(self, job_id: str | None = None) -> DataFrame:
        df = self._read("estimators", self.EST_SCHEMA)
        return df if job_id is None else df.filter(F.col("job_id") == job_id)

    # K5 -------------------------------------------------------------------
    METRICS_SCHEMA = "estimator_id string, " + ", ".join(f"{c} double" for c in METRIC_COLUMNS)

    def save_metrics(self, estimator_id: str, metrics: DataFrame) -> None:
        metrics.select(F.lit(estimator_id).alias("estimator_id"), *METRIC_COLUMNS) \
            .coalesce(1).write.mode("append").parquet(self._t("metrics"))

    def metrics(self, estimator_id: str | None = None) -> DataFrame:
        df = self._read("metrics", self.METRICS_SCHEMA)
        return df if estimator_id is None else df.filter(F.col("estimator_id") == estimator_id)

    # K7 -------------------------------------------------------------------
    def leaderboard(self, metric: str = "MCC") -> DataFrame:
        return (self.jobs().join(self.estimators(), "job_id").join(self.metrics(), "estimator_id")
                .select("plan_id", "job_id", "estimator_id", "model", *METRIC_COLUMNS)
                .orderBy(F.col(metric).desc(), "estimator_id"))
