"""Distributed, deterministic ranking and exact quantiles.

``index_sorted`` numbers rows 0..n-1 in a total order without a single
global partition and without depending on a range exchange being computed
the same way twice:

1. bucket boundaries: a seeded sample of the first order column, sorted by
   Spark, cut into at most ``MAX_BUCKETS`` pieces (driver: one value per
   bucket);
2. each row's bucket is a native binary CASE tree over the boundaries
   (monotone in the order, so buckets are ordered ranges);
3. per-bucket row counts (one small row per bucket) give offsets;
4. rank = offset of the bucket + ``row_number()`` inside the bucket.

Every step is a deterministic function of the data, so a recomputed stage
(lost executor) yields the same ranks.  Callers order by a seeded hash or by
distinct values, so a bucket never holds a long run of equal first keys.

``exact_quantiles`` works on value counts (map-side combined, so a value
repeated in a third of the rows is one row) with prefix sums over the
sorted distinct values.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudframe.session import ensure_checkpoint_dir

MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 1_000_000
SAMPLE_PER_BUCKET = 40
SEED = 17


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _buckets(n: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(n / ROWS_PER_BUCKET)))


def _boundaries(df: DataFrame, c: Column, n: int, buckets: int) -> list:
    if buckets <= 1 or n == 0:
        return []
    frac = min(1.0, SAMPLE_PER_BUCKET * buckets / n)
    sample = [r[0] for r in df.select(c.alias("__s")).filter(F.col("__s").isNotNull())
              .sample(False, frac, SEED).orderBy("__s").collect()]
    if not sample:
        return []
    step = len(sample) / buckets
    out: list = []
    for i in range(1, buckets):
        v = sample[min(int(i * step), len(sample) - 1)]
        if not out or v != out[-1]:
            out.append(v)
    return out


def count_at_most(c: Column, bounds: list) -> Column:
    """Number of ``bounds`` (ascending) that are <= c, as a binary CASE tree
    (depth log2(len); used for at most MAX_BUCKETS - 1 bounds)."""
    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(bounds[mid]), rec(mid + 1, hi)).otherwise(rec(lo, mid))
    return rec(0, len(bounds))


def index_sorted(df: DataFrame, order: list[Column | str], name: str = "rank", n: int | None = None) -> DataFrame:
    """Add a 0-based ``name`` column following ``order``; give a total order
    (e.g. end with a unique key) for ranks that never change.  ``n``: the row
    count when the caller knows it."""
    n = df.count() if n is None else n
    buckets = _buckets(n)
    c0 = _col(order[0])
    bounds = _boundaries(df, c0, n, buckets)
    tagged = df.withColumn("__bk", count_at_most(c0, bounds))
    counts = sorted((r[0], r[1]) for r in tagged.groupBy("__bk").count().collect())
    offsets, run = [], 0
    for b, cnt in counts:
        offsets.append((b, run))
        run += cnt
    w = Window.partitionBy("__bk").orderBy(*order)
    if not bounds:  # one bucket (at most ROWS_PER_BUCKET rows): offset 0, no join
        return tagged.withColumn(name, (F.row_number().over(w) - 1).cast("bigint")).drop("__bk")
    # one row per bucket: at most MAX_BUCKETS + 1 rows
    off = df.sparkSession.createDataFrame(offsets, "__bk int, __off long")
    return (tagged.join(F.broadcast(off), "__bk")
            .withColumn(name, (F.col("__off") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("__bk", "__off"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """``exact_quantiles_of`` of one column."""
    return exact_quantiles_of(df, [col], probs)[col]


def exact_quantiles_of(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (numpy's default) of the non-NULL
    values of each column, in the same few jobs for all columns; only the
    values at the <= 2*len(probs) needed ranks of a column reach the driver."""
    if not cols:
        return {}
    ensure_checkpoint_dir(df.sparkSession)
    # one pass over the rows: (column, value) counts, combined before the shuffle
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col(c).cast("double").alias("x"))
                                         for i, c in enumerate(cols)])).alias("v"))
    vc = (long.select("v.*").filter(F.col("x").isNotNull())
          .groupBy("j", "x").agg(F.count(F.lit(1)).alias("c")).checkpoint())
    totals = {r["j"]: (r["n"], r["nd"]) for r in vc.groupBy("j").agg(F.sum("c").alias("n"), F.count("*").alias("nd")).collect()}
    bounds = {j: _boundaries(vc.filter(F.col("j") == j), F.col("x"), nd, _buckets(nd)) for j, (_, nd) in totals.items()}
    bucket = F.lit(0)
    for j, b in bounds.items():
        if b:
            bucket = F.when(F.col("j") == j, count_at_most(F.col("x"), b)).otherwise(bucket)
    tagged = vc.withColumn("__bk", bucket)
    sums = sorted((r["j"], r["__bk"], r["n"]) for r in tagged.groupBy("j", "__bk").agg(F.sum("c").alias("n")).collect())
    # rows strictly before each distinct value: prefix sums in value order
    offsets, run, last = [], 0, None
    for j, b, n in sums:
        run, last = (run if j == last else 0), j
        offsets.append((j, b, run, max(1, math.ceil(totals[j][0] / MAX_BUCKETS))))
        run += n
    if not offsets:
        return {c: [None] * len(probs) for c in cols}
    # one row per column and bucket
    off = df.sparkSession.createDataFrame(offsets, "j int, __bk int, __off long, __step long")
    w = Window.partitionBy("j", "__bk").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tagged.join(F.broadcast(off), ["j", "__bk"]).withColumn(
        "__cb", F.col("__off") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    # which distinct value holds each needed rank: key ranks by rank // step,
    # explode each value's rank range [cb, cb + c) over the keys it spans
    # (at most n / step + distinct values rows), equi-join the small target list
    need, targets = {}, []
    for j, _, _, step in {(o[0], 0, 0, o[3]) for o in offsets}:
        pos = [(totals[j][0] - 1) * p for p in probs]
        need[j] = sorted({math.floor(h) for h in pos} | {math.ceil(h) for h in pos})
        targets += [(j, r, r // step) for r in need[j]]
    wanted = df.sparkSession.createDataFrame(targets, "j int, __r long, __key long")
    spans = ranked.select("j", "x", "c", "__cb", F.explode(F.sequence(
        F.floor(F.col("__cb") / F.col("__step")).cast("long"),
        F.floor((F.col("__cb") + F.col("c") - 1) / F.col("__step")).cast("long"))).alias("__key"))
    hits = (spans.join(F.broadcast(wanted), ["j", "__key"])
            .filter((F.col("__r") >= F.col("__cb")) & (F.col("__r") < F.col("__cb") + F.col("c")))
            .select("j", "__r", "x").collect())
    got = {(r["j"], r["__r"]): r["x"] for r in hits}
    out: dict[str, list[float | None]] = {}
    for j, c in enumerate(cols):
        if j not in totals:
            out[c] = [None] * len(probs)
            continue
        ends = [(h, got[j, math.floor(h)], got[j, math.ceil(h)]) for h in ((totals[j][0] - 1) * p for p in probs)]
        out[c] = [a + (b - a) * (h - math.floor(h)) for h, a, b in ends]
    return out
