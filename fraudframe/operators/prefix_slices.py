"""Exact medians of every prefix of a sequence that is cut into chunks.

A sequence too long for one task is cut into time chunks.  The median of everything
before a row needs all earlier chunks, but of their values only those at a few ranks: with m
earlier values and r rows in the chunk, the k-th smallest of m + p values (p of them in the
chunk) has a rank from k - p to k among the earlier ones, so ranks from (m - r - 1) / 2 to
(m + r) / 2 are enough, about r values.  ``prefix_slices`` finds them for all chunks
of all sequences at once:

1. equal values of a chunk become one row with a count,
2. estimated quantiles cut each sequence's values into buckets of about r rows
   (estimates decide how much is moved, never what is found),
3. counts by (bucket, chunk), summed along the chunks, tell which buckets hold a chunk's
   ranks,
4. rows of these buckets in earlier chunks are sent to the chunk, at most about three
   times its own number, summed by value and cut to the exact ranks.

Step 3 makes (buckets x chunks) rows a sequence, a thousand of each for a thousand times
``rows_per_task``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Estimated quantiles are asked for in this many pieces at most.
MOST_BUCKETS = 4096


def _bucket(bounds: str, step: int):
    """How many bounds are below the value: coarse steps first, then inside one step."""
    coarse = F.size(F.filter(F.col("coarse"), lambda b: b < F.col("value")))
    inside = F.slice(F.col(bounds), coarse * step + 1, F.lit(step))
    return coarse * step + F.size(F.filter(inside, lambda b: b < F.col("value")))


def prefix_slices(values: DataFrame, chunks: DataFrame, entity: str, chunk: str, rows_per_task: int) -> DataFrame:
    """``values`` (entity, chunk, gap) and ``chunks`` (entity, chunk, __lb_own rows, __lb_gaps values in
    earlier chunks) to (entity, chunk, __lb_sv value, __lb_sn count, __lb_below, __lb_gaps): the earlier
    values at the chunk's ranks, how many are smaller and how many there are."""
    counted = values.groupBy(entity, chunk, F.col("gap").alias("value")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    most = counted.groupBy(entity).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(2, min(MOST_BUCKETS, -(-most // max(rows_per_task, 1))))
    step = max(1, round(buckets ** 0.5))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = values.groupBy(entity).agg(F.array_sort(F.array_distinct(F.percentile_approx("gap", cuts, max(1000, 4 * buckets)))).alias("bounds"))
    bounds = bounds.withColumn("coarse", F.filter("bounds", lambda b, i: i % step == step - 1))
    placed = counted.join(bounds, entity).withColumn("bucket", _bucket("bounds", step)).select(entity, chunk, "value", "n", "bucket")

    low = F.greatest(F.floor((F.col("__lb_gaps") - F.col("__lb_own") - 1) / 2), F.lit(0))
    high = F.least(F.floor((F.col("__lb_gaps") + F.col("__lb_own")) / 2), F.col("__lb_gaps") - 1)
    ranks = chunks.filter("__lb_gaps > 0").select(entity, chunk, "__lb_gaps", low.cast("long").alias("low"), high.cast("long").alias("high"))

    by_bucket = placed.groupBy(entity, "bucket", chunk).agg(F.sum("n").alias("n")).checkpoint()
    grid = ranks.join(by_bucket.select(entity, "bucket").distinct(), entity)
    earlier = Window.partitionBy(entity, "bucket").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy(entity, chunk).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a chunk without ranks (nothing before it) still counts towards the later ones
    every = by_bucket.select(entity, "bucket", chunk).unionByName(grid.select(entity, "bucket", chunk)).distinct()
    held = every.join(by_bucket, [entity, "bucket", chunk], "left").withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    needed = (held.join(ranks, [entity, chunk]).withColumn("below", F.coalesce(F.sum("earlier").over(smaller), F.lit(0)))
              .filter("earlier > 0 and below <= high and below + earlier > low")
              .select(entity, "bucket", F.col(chunk).alias("target"), "low", "high", "__lb_gaps", F.min("below").over(Window.partitionBy(entity, chunk)).alias("below")))

    sent = (placed.join(needed, [entity, "bucket"]).filter(F.col(chunk) < F.col("target"))
            .groupBy(entity, "target", "value").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("low", "high", "below", "__lb_gaps")]))
    upto = Window.partitionBy(entity, "target").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("n").over(upto), F.lit(0))
    cut = sent.withColumn("start", start).withColumn("n", F.least(F.col("start") + F.col("n"), F.col("high") + 1) - F.greatest(F.col("start"), F.col("low")))
    return cut.filter("n > 0").select(entity, F.col("target").alias(chunk), F.col("value").alias("__lb_sv"), F.col("n").alias("__lb_sn"),
                                      F.col("low").alias("__lb_below"), "__lb_gaps")
