"""Rows that come too late for a stateful stream, in a table of their own (survey J5).

The engine drops rows behind a query's watermark and only counts them.  ``start_late_router``
reads the raw stream first and deals every micro-batch to two tables: rows at least as
new as the newest time of all earlier micro-batches less ``lateness`` are accepted, older ones are
late and written with their delay behind that time.  Accepted plus late rows are the input.
A row without a time is late, its delay NULL.

The accepted table is the source of the stateful query (``accepted_stream``).  A micro-batch
of that query holds whole accepted batches in order, so its watermark is never ahead of the
router's, and with the same ``lateness`` it drops nothing.

Batches are folders named by their id.  The newest time so far is stored with each; a batch
that is run again after a failure finds what it had found before and leaves finished folders alone.
"""
from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudframe.functions.columns import epoch_micros

DELAY = "late_by_us"


def _finished(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write(df: DataFrame, path: str) -> None:
    if not _finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)


def start_late_router(stream: DataFrame, time: str, accepted: str, late: str, checkpoint: str, lateness: str = "1 day", trigger: dict | None = None):
    """Start the query that deals ``stream`` to the folders ``accepted`` and ``late``."""
    us = epoch_micros(time, stream.schema[time].dataType)

    def deal(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = os.path.join(late, "newest")
        before = None
        if batch_id:
            before = spark.read.parquet(os.path.join(marks, f"batch_id={batch_id - 1}")).first()["newest"]
        batch = batch.withColumn("__us", us).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            newest = batch.agg(F.max("__us").alias("newest")).select(F.greatest("newest", F.lit(before).cast("long")).alias("newest"))
            bound = F.unix_micros(F.timestamp_micros(F.lit(before).cast("long")) - F.expr(f"INTERVAL {lateness}"))
            # nothing is late for the first rows
            on_time = F.col("__us").isNotNull() & F.coalesce(F.col("__us") >= bound, F.lit(True))
            _write(batch.filter(on_time).drop("__us"), os.path.join(accepted, f"batch_id={batch_id}"))
            behind = batch.filter(~on_time).withColumn(DELAY, F.lit(before).cast("long") - F.col("__us")).drop("__us")
            _write(behind, os.path.join(late, "rows", f"batch_id={batch_id}"))
            _write(newest.coalesce(1), os.path.join(marks, f"batch_id={batch_id}"))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def accepted_stream(spark: SparkSession, accepted: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The accepted rows as a stream, oldest batches first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(os.path.join(accepted, "batch_id=*"))


def late_rows(spark: SparkSession, late: str) -> DataFrame:
    """All late rows with ``late_by_us``, the time by which each was behind the newest row before its batch."""
    return spark.read.parquet(os.path.join(late, "rows")).drop("batch_id")
