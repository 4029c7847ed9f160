"""Quantiles of many columns from mergeable sketches, in one pass.

Every partition keeps one KLL sketch a column (Spark's own aggregate); sketches, not
values, are shuffled, and merged in two steps so that no task reads one of every
partition.  The rank of a returned value is off by at most about ``rank_error(k)`` of the
rows (with 99 % confidence); the values at levels 0 and 1 are the exact least and greatest.
Sketches draw random bits, so two runs may differ within that error; use
``ranking.exact_quantiles_of`` where runs must agree.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch: at 8192 about 200 KB and an error of 0.07 % of the rows.
SIZE = 8192
#: Tasks of the first merging step.
MERGERS = 64


def rank_error(k: int = SIZE) -> float:
    """Share of the rows by which a rank may be off (the sketch's published fit)."""
    return 2.296 / k ** 0.9021


def quantile_sketches(df: DataFrame, cols: list[str], k: int = SIZE) -> DataFrame:
    """One row with a sketch for each column, named s0, s1, ...; NULL where it has no value.  NULL and NaN don't count."""
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]
    staged = df.select((F.spark_partition_id() % MERGERS).alias("merger"), *values)
    some = staged.groupBy("merger").agg(*[F.when(F.count(f"x{i}") > 0, F.kll_sketch_agg_double(f"x{i}", F.lit(k))).alias(f"s{i}")
                                          for i in range(len(cols))])
    return some.agg(*[F.when(F.count(f"s{i}") > 0, F.kll_merge_agg_double(f"s{i}", F.lit(k))).alias(f"s{i}") for i in range(len(cols))])


def sketch_quantiles_of(df: DataFrame, cols: list[str], probs: list[float], k: int = SIZE) -> dict[str, list[float | None]]:
    """Like ``ranking.exact_quantiles_of`` within the sketch's error; None for each level of a column without values."""
    levels = F.array(*[F.lit(float(p)) for p in probs])
    row = quantile_sketches(df, cols, k).select(
        *[F.when(F.col(f"s{i}").isNotNull(), F.kll_sketch_get_quantile_double(f"s{i}", levels)).alias(f"q{i}") for i in range(len(cols))]).first()
    return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs) for i, c in enumerate(cols)}


def sketch_ranks(df: DataFrame, cols: list[str], probs: list[float], k: int = SIZE) -> DataFrame:
    """column, level, n and rank_off: the share of the n values by which the sketch's value misses its level, counted exactly."""
    quantiles = sketch_quantiles_of(df, cols, probs, k)
    counts, rows = [], []
    for i, c in enumerate(cols):
        x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        counts.append(F.count(x).alias(f"n{i}"))
        for j, (p, q) in enumerate(zip(probs, quantiles[c])):
            counts += [F.count(F.when(x < q, 1)).alias(f"b{i}_{j}"), F.count(F.when(x <= q, 1)).alias(f"e{i}_{j}")]
            n = F.col(f"n{i}")
            off = F.greatest(F.lit(0.0), F.col(f"b{i}_{j}") / n - p, F.lit(p) - F.col(f"e{i}_{j}") / n)
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("level"), n.alias("n"), off.alias("rank_off")))
    return df.agg(*counts).select(F.inline(F.array(*rows)))
