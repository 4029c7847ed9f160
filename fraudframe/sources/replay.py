"""Replay a table as a stream: rows cut into time slices, one parquet file
per slice, written one after the other so that a file source with
``maxFilesPerTrigger=1`` reads them in time order, one per micro-batch."""
from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudframe.functions.columns import epoch_micros
from fraudframe.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


#: Lets a query's shuffle files go when it ends; stages are run again should they be needed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> DataFrame:
    """The rows, written to ``path`` and read from there; the shuffle files of the job don't outlive it."""
    spark = df.sparkSession
    writer = df.write.mode(mode)
    with setting(spark, CLEANUP, "true"):
        (writer.option("compression", compression) if compression else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_time_slices(df: DataFrame, time_col: str, path: str, slices: int) -> None:
    """Write ``slices`` consecutive time ranges of ``df``, one file each, in order."""
    us = epoch_micros(time_col, df.schema[time_col].dataType)
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    width = max(1, -(-(hi - lo + 1) // slices))
    tagged = df.withColumn("__slice", F.floor((us - F.lit(lo)) / F.lit(width)))
    for i in range(slices):
        tagged.filter(F.col("__slice") == i).drop("__slice").coalesce(1).write.mode("append").parquet(path)
