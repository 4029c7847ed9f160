"""Intermediate tables in the shared folder that spark.checkpoint.dir names."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fraudframe.session import ensure_checkpoint_dir


class Scratch:
    """A folder of this run's tables.  Executors that are lost recompute from these
    files, never from another executor's disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the table read back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
