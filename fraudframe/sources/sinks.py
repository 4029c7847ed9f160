"""Sinks (survey 2.A, A9 / A10): derived tables are parquet datasets written
by Spark's parallel writer; scored rows are appended without a label."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_unlabelled(df: DataFrame, path: str, label: str) -> None:
    """Append scored rows to a feature table with the label left NULL."""
    df.withColumn(label, F.lit(None).cast("double")).write.mode("append").parquet(path)
