"""Train/test split and class resampling (survey 2.E).

Every random choice is a seeded hash of the row key (``xxhash64``; keys are
unique and not NULL), so results do not move with partitioning or executor
loss (``randomSplit`` / ``sample`` would).  Sizes are exact: the hash and key
at the wanted rank are found on the key column alone, and the rows are then
filtered where they are, so wide rows are neither shuffled nor sorted.

* ``split_train_test``: the ``ceil(n * test_size)`` rows with the smallest
  hash form the test part.
* ``under_sample``: all minority rows, the ``int(n_min / ratio)`` majority
  rows with the smallest hash.
* ``over_sample``: all rows plus ``int(ratio * n_maj) - n_min`` minority
  draws with replacement (draw j takes minority row ``hash(j) mod n_min``).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudframe.functions.ranking import index_sorted

SAMPLING_RATIO = 0.5


class RatioAlreadyReached(ValueError):
    pass


def _hash(key: str, seed: int):
    return F.xxhash64(F.col(key), F.lit(seed))


def _lowest(df: DataFrame, key: str, seed: int, n: int, cut: int) -> Column:
    """Condition on the ``cut`` of ``n`` rows with the smallest (hash, key)."""
    if cut <= 0 or cut >= n:
        return F.lit(cut > 0)
    keys = df.select(_hash(key, seed).alias("__h"), F.col(key).alias("__k"))
    h, k = index_sorted(keys, ["__h", "__k"], "__r", n=n).filter(F.col("__r") == cut - 1).select("__h", "__k").first()
    return (_hash(key, seed) < F.lit(h)) | ((_hash(key, seed) == F.lit(h)) & (F.col(key) <= F.lit(k)))


def split_train_test(df: DataFrame, key: str, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """Adds ``is_test`` (boolean); exactly ``ceil(n * test_size)`` rows are test rows."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be strictly between 0 and 1")
    n = df.count()
    return df.withColumn("is_test", _lowest(df, key, seed, n, math.ceil(n * test_size)))


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows of each class, of at most three: two are expected."""
    return {int(r[0]): r[1] for r in df.groupBy(label).count().limit(3).collect()}


def _minority_majority(counts: dict[int, int]) -> tuple[int, int]:
    if len(counts) != 2:
        raise ValueError(f"two classes expected, got {sorted(counts)}")
    a, b = sorted(counts, key=lambda c: (counts[c], c))
    return a, b


def under_sample(df: DataFrame, label: str, key: str, ratio: float = SAMPLING_RATIO, seed: int = 0) -> DataFrame:
    counts = class_counts(df, label)
    mino, majo = _minority_majority(counts)
    if counts[mino] / counts[majo] > ratio:
        raise RatioAlreadyReached(f"minority/majority is already {counts[mino] / counts[majo]:.3f} > {ratio}")
    keep = int(counts[mino] / ratio)
    maj = df.filter(F.col(label) == majo)
    low = _lowest(maj, key, seed, counts[majo], keep)
    return df.filter((F.col(label) == mino) | ((F.col(label) == majo) & low))


def over_sample(df: DataFrame, label: str, key: str, ratio: float = SAMPLING_RATIO, seed: int = 0) -> DataFrame:
    counts = class_counts(df, label)
    mino, majo = _minority_majority(counts)
    if counts[mino] / counts[majo] > ratio:
        raise RatioAlreadyReached(f"minority/majority is already {counts[mino] / counts[majo]:.3f} > {ratio}")
    n_min = counts[mino]
    extra = int(ratio * counts[majo]) - n_min
    if extra <= 0:
        return df
    spark = df.sparkSession
    minority = index_sorted(df.filter(F.col(label) == mino).withColumn("__h", _hash(key, seed)),
                            ["__h", key], "__r", n=n_min).drop("__h")
    draws = spark.range(extra).select(
        F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 1)), F.lit(n_min)).alias("__r"))
    # equi-join on the drawn index; both sides grow with the data, so Spark
    # decides broadcast vs shuffle from their size statistics
    picked = draws.join(minority, "__r").drop("__r")
    return df.unionByName(picked)
