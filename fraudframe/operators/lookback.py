"""Per-entity look-back features over day intervals (survey section 2.D).

For every row of a transaction table and every interval ``k`` (whole days)
fourteen features are derived from the same entity's earlier rows:

  1-6   the chosen value against the mean / median / deviation of the values
        in the last k days,
  7-10  the number of rows in the last 24 hours against the daily numbers,
  11-14 the gap to the previous row against the usual gap.

All of it is one ``Window.partitionBy(entity).orderBy(us)`` spec with RANGE
frames over whole microseconds, so a plan has exactly one hash exchange and
one sort.  Open interval bounds become closed ones exactly on integers:
``(t - k days, t)`` is ``rangeBetween(-k*D + 1, -1)``.

Three profiles (see README):

* ``canonical`` (default): strictly prior history, the row's own value,
  (value - mean) / deviation, gaps inside the interval, a first row of an
  entity gets zeros.  Batch and streaming compute the same numbers.
* ``train``: the batch behaviour of the original trainer, quirks included
  (the "current" value is the entity's oldest prior value, equal timestamps
  collapse to one value, gaps ignore the interval, the oldest row of every
  entity is dropped).
* ``serve``: the online scorer's behaviour: the current row is part of the
  window, the daily median is taken over calendar (Julian) days.

Skew: an entity with more rows than ``SkewPolicy.rows_per_task`` is cut into
time chunks; each chunk carries the ``max(K)`` days before it as read-only
context rows (a row is copied to every later chunk it reaches, at most
``SkewPolicy.max_copies``, so chunks may be shorter than the interval), and the
newest row before the chunk comes from a per-chunk aggregate, so no task ever
holds a whole hot entity
(``train`` also needs the median of all earlier gaps of the entity: each chunk
starts with the earlier gaps at the ranks its medians can fall on, from
``prefix_slices``).
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from fraudframe.functions.columns import (
    MICROS_PER_DAY,
    array_median,
    epoch_micros,
    safe_div,
)
from fraudframe.operators.frames import add_frame_statistics
from fraudframe.operators.prefix_slices import prefix_slices
from fraudframe.session import ensure_checkpoint_dir

D = MICROS_PER_DAY
PROFILES = ("canonical", "train", "serve")

_US = "__lb_us"
_V = "__lb_v"
_CHUNK = "__lb_chunk"
_CTX = "__lb_ctx"
_PREV = "__lb_prev_us"


@dataclass(frozen=True)
class LookbackSpec:
    """What to compute: entity (card) column, time column, chosen value
    column, interval list in days, optional label column kept last.

    ``tie`` (a unique key) orders an entity's rows of equal time, which the
    ``train`` profile needs; without it they are ordered by value, then by a
    hash of all plain columns.
    """

    entity: str
    time: str
    value: str
    intervals: tuple[int, ...]
    label: str | None = None
    profile: str = "canonical"
    tie: str | None = None

    def __post_init__(self):
        if not self.intervals:
            raise ValueError("intervals must not be empty")
        for k in self.intervals:
            if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
                raise ValueError(f"interval {k!r} is not a positive whole number of days")
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}; one of {PROFILES}")
        object.__setattr__(self, "intervals", tuple(self.intervals))


@dataclass(frozen=True)
class SkewPolicy:
    """When and how to split an entity that would not fit one task.

    ``rows_per_task``: an entity with more rows is cut into time chunks of
    about this many rows.  A list of at most ``max_split_entities`` split
    entities is broadcast; a longer one is joined by a shuffle.  A row is
    copied as context to at most ``max_copies`` later chunks.
    """

    rows_per_task: int = 1_000_000
    max_split_entities: int = 200_000
    max_copies: int = 8
    enabled: bool = True


def feature_names(value: str, intervals) -> list[str]:
    """The 14 feature column names per interval, in output order."""
    out: list[str] = []
    for k in intervals:
        out += [
            f"{value}_current_per_average_{k}",
            f"{value}_current_minus_average_{k}",
            f"{value}_current_per_median_{k}",
            f"{value}_current_minus_median_{k}",
            f"{value}_current_minus_average_{k}_per_deviation_{k}",
            f"{value}_current_minus_average_{k}_minus_deviation_{k}",
            f"tr_nr_per_avg_nr_{k}",
            f"tr_nr_minus_avg_nr_{k}",
            f"tr_nr_per_median_nr_{k}",
            f"tr_nr_minus_median_nr_{k}",
            f"avg_tr_interval_per_tr_interval_{k}",
            f"avg_tr_interval_minus_tr_interval_{k}",
            f"median_tr_interval_per_tr_interval_{k}",
            f"median_tr_interval_minus_tr_interval_{k}",
        ]
    return out


def _prior(w, days: int, inclusive: bool) -> Column:
    """Rows of the partition at most (or less than) t - days; such a count grows row by row."""
    return F.count(_US).over(w.rangeBetween(Window.unboundedPreceding, -days * D - (0 if inclusive else 1)))


def _counts(w, intervals, buckets: bool) -> dict[str, Column]:
    """``__p{i}`` rows before t - i days, ``__q{i}`` rows up to it.  Their differences are the
    sizes of open frames: (t - k days, t) holds ``__p0 - __q{k}`` rows."""
    most = max(intervals)
    before = range(most) if buckets else [0]
    upto = range(1, most + 1) if buckets else sorted({1, *intervals})
    return {**{f"__p{i}": _prior(w, i, False) for i in before}, **{f"__q{i}": _prior(w, i, True) for i in upto}}


def _sizes(intervals, buckets: bool) -> dict[str, Column]:
    out = {f"__n{k}": _c("__p0") - _c(f"__q{k}") for k in intervals}
    if buckets:
        out.update({f"__b{i}": _c(f"__p{i}") - _c(f"__q{i + 1}") for i in range(max(intervals))})
    return out


def _count_features(n_today: Column, avg_nr: Column, med_nr: Column) -> list[Column]:
    return [safe_div(n_today, avg_nr), n_today - avg_nr, safe_div(n_today, med_nr), n_today - med_nr]


def _gap_features(avg_gap: Column, med_gap: Column, g: Column) -> list[Column]:
    return [safe_div(avg_gap, g), avg_gap - g, safe_div(med_gap, g), med_gap - g]


def _days(us_diff: Column) -> Column:
    return us_diff.cast("double") / F.lit(float(D))


# ---------------------------------------------------------------------------
# profiles.  Four steps, one after the other:
#   1. window columns (prefix counts, each named and so evaluated once),
#   2. frame sizes from them,
#   3. order statistics and moments of the frames (operators/frames.py),
#   4. the features, plain arithmetic on the columns of 1-3.
# ---------------------------------------------------------------------------

def _c(name: str) -> Column:
    return F.col(name)


def _bucket_median(k: int) -> dict[str, Column]:
    total = sum((_c(f"__b{i}") for i in range(1, k)), _c("__b0"))
    return {f"__avgnr{k}": total.cast("double") / k,
            f"__mednr{k}": array_median(F.array(*[_c(f"__b{i}") for i in range(k)]))}


# Columns shared by the profiles, from the window order of rows:
#   __first  the row is the first of its partition
#   __gp     gap to the previous row of the entity in us, -1 for the first row
#   __day    calendar Julian day number of the row
_GP = "__gp"
_DAY = "__day"
_FIRST = "__first"


def _row_columns(w, split: bool = False) -> dict[str, Column]:
    us = _c(_US)
    before = F.lag(us).over(w)
    # an own row that leads its chunk; rows that are there as context only have no such gap
    gap = F.coalesce(us - before, F.when(~_c(_CTX), us - _c(_PREV))) if split else us - before
    return {_FIRST: F.lag(F.lit(1)).over(w).isNull(), _GP: F.coalesce(gap, F.lit(-1).cast("bigint"))}


def _canonical(spec: LookbackSpec, split: bool):
    v = _c(_V).cast("double")
    us = _c(_US)
    newest = F.coalesce(_c("__newest"), _c(_PREV)) if split else _c("__newest")
    mid: dict[str, Column] = {
        "__has_prior": newest.isNotNull(),
        "__g": F.coalesce(_days(us - newest), F.lit(0.0)),
    }
    for k in spec.intervals:
        n = _c(f"__n{k}")
        # the newest row of a frame with two rows is the newest row before t
        mid[f"__avggap{k}"] = F.when(n >= 2, _days(_c("__newest") - _c(f"__lo{k}")) / (n - 1)).otherwise(F.lit(0.0))
        mid.update(_bucket_median(k))
    n_today = (_c("__b0") + 1).cast("double")
    out: list[Column] = []
    for k in spec.intervals:
        avg, med, dev = _c(f"__avg{k}"), _c(f"__med{k}"), _c(f"__dev{k}")
        cols = [
            safe_div(v, avg), v - avg, safe_div(v, med), v - med,
            safe_div(v - avg, dev), v - avg - dev,
            *_count_features(n_today, _c(f"__avgnr{k}"), _c(f"__mednr{k}")),
            *_gap_features(_c(f"__avggap{k}"), _c(f"__medgap{k}") / F.lit(float(D)), _c("__g")),
        ]
        out += [F.when(_c("__has_prior"), c).otherwise(F.lit(0.0)) for c in cols]
    return mid, out


def _serve(spec: LookbackSpec):
    """History of the last k days plus the current row ("combined")."""
    v = _c(_V).cast("double")
    us = _c(_US)
    n_today = (_c("__p0") - _c("__q1") + 1).cast("double")
    out: list[Column] = []
    for k in spec.intervals:
        h = _c(f"__n{k}")
        avg, med, dev = _c(f"__avg{k}"), _c(f"__med{k}"), _c(f"__dev{k}")
        avg_gap = _days(us - _c(f"__lo{k}")) / F.greatest(h, F.lit(1))
        cols = [
            safe_div(v, avg), v - avg, safe_div(v, med), v - med,
            safe_div(v - avg, dev), v - avg - dev,
            *_count_features(n_today, (h + 1).cast("double") / k, _c(f"__mednr{k}")),
            *_gap_features(avg_gap, _c(f"__medgap{k}") / F.lit(float(D)), _days(us - _c(f"__hi{k}"))),
        ]
        out += [F.when(h > 0, c).otherwise(F.lit(0.0)) for c in cols]
    return {}, out


def _train(spec: LookbackSpec, split: bool):
    """Columns of the original batch trainer."""
    us = _c(_US)
    n_prior, newest, oldest, first_v = _c("__p0"), _c("__newest"), _c("__oldest"), _c("__first_v")
    if split:
        hot = _c("__lb_oldest").isNotNull()
        n_prior = F.when(hot, n_prior - _c("__n_ctx") + _c("__lb_rows")).otherwise(n_prior)
        newest = F.coalesce(newest, _c(_PREV))
        oldest = F.when(hot, _c("__lb_oldest")).otherwise(oldest)
        first_v = F.when(hot, _c("__lb_first_v")).otherwise(first_v)
    mid: dict[str, Column] = {
        # the "current" value the trainer used: the oldest prior value, own value without history
        "__cur": F.when(n_prior > 0, first_v.cast("double")).otherwise(_c(_V).cast("double")),
        "__g": F.coalesce(_days(us - newest), F.lit(0.0)),
        "__avggap": F.when(n_prior >= 2, _days(newest - oldest) / (n_prior - 1)).otherwise(F.lit(0.0)),
    }
    for k in spec.intervals:
        mid.update(_bucket_median(k))
    n_today = (_c("__b0") + 1).cast("double")
    v = _c("__cur")
    out: list[Column] = []
    for k in spec.intervals:
        avg, med, dev = _c(f"__avg{k}"), _c(f"__med{k}"), _c(f"__dev{k}")
        out += [
            safe_div(v, avg), v - avg, safe_div(v, med), v - med,
            safe_div(v, dev), v - dev,
            *_count_features(n_today, _c(f"__avgnr{k}"), _c(f"__mednr{k}")),
            *_gap_features(_c("__avggap"), _c("__medgap") / F.lit(float(D)), _c("__g")),
        ]
    return mid, out


def _features(rows: DataFrame, spec: LookbackSpec, partition: list[str], keep: list[str], extra: list[str], split: bool) -> DataFrame:
    """The features of rows that carry __first, __gp and the profile's split columns."""
    w = Window.partitionBy(*partition).orderBy(_US)
    prior = w.rangeBetween(Window.unboundedPreceding, -1)
    buckets = spec.profile != "serve"
    columns = _counts(w, spec.intervals, buckets)
    if spec.profile != "serve":
        columns["__newest"] = F.max(_US).over(prior)
    if spec.profile == "train":
        columns["__oldest"] = F.min(_US).over(prior)
        if split:
            columns["__n_ctx"] = F.count(F.when(_c(_CTX), _c(_US))).over(prior)
    df = rows.withColumns(columns).withColumns(_sizes(spec.intervals, buckets))
    df = add_frame_statistics(df, spec.profile, spec.intervals)
    mid, out = {"canonical": lambda: _canonical(spec, split), "serve": lambda: _serve(spec), "train": lambda: _train(spec, split)}[spec.profile]()
    if mid:
        df = df.withColumns(mid)
    tail = [spec.label] if spec.label else []
    return df.select(*keep, *[c.alias(n) for c, n in zip(out, feature_names(spec.value, spec.intervals))], *tail, *extra)


# ---------------------------------------------------------------------------
# skew split
# ---------------------------------------------------------------------------

def _split_plan(base: DataFrame, entity: str, context_us: int, policy: SkewPolicy):
    """Entities to cut into time chunks: (entity, first us, chunk length, last
    chunk).

    Returns None when no entity exceeds ``rows_per_task``.  The list is
    broadcast only when it has at most ``max_split_entities`` rows.
    """
    stats = (base.select(entity, _US).groupBy(entity)
             .agg(F.count(F.lit(1)).alias("__n"), F.min(_US).alias("__lo"), F.max(_US).alias("__hi")))
    span = F.col("__hi") - F.col("__lo") + 1
    shortest = -(-context_us // policy.max_copies)
    chunk = F.greatest(F.lit(shortest), F.ceil(span * F.lit(policy.rows_per_task) / F.col("__n")).cast("bigint"))
    plan = (stats.filter(F.col("__n") > policy.rows_per_task)
            .select(entity, F.col("__lo").alias("__lb_lo"), chunk.alias("__lb_len"), "__hi")
            .withColumn("__lb_last", F.floor((F.col("__hi") - F.col("__lb_lo")) / F.col("__lb_len"))).drop("__hi"))
    # one job: per-entity counts (map-side combined), only hot rows come
    # back, at most max_split_entities + 1 of them
    rows = plan.limit(policy.max_split_entities + 1).collect()
    if not rows:
        return None
    if len(rows) > policy.max_split_entities:
        return plan
    return F.broadcast(base.sparkSession.createDataFrame(rows, plan.schema))


def _with_chunks(base: DataFrame, entity: str, context_us: int, plan: DataFrame, with_prev: bool) -> DataFrame:
    joined = base.join(plan, on=entity, how="left")
    is_hot = F.col("__lb_len").isNotNull()
    chunk = F.when(is_hot, F.floor((F.col(_US) - F.col("__lb_lo")) / F.col("__lb_len"))).otherwise(F.lit(0)).cast("bigint")
    joined = joined.withColumn(_CHUNK, chunk)
    # the last chunk that starts less than the context after this row
    reach = F.floor((F.col(_US) + F.lit(context_us - 1) - F.col("__lb_lo")) / F.col("__lb_len"))
    last = F.when(is_hot, F.greatest(F.col(_CHUNK), F.least(reach, F.col("__lb_last")))).otherwise(F.lit(0)).cast("bigint")
    rows = (joined.withColumn("__lb_copy", F.explode(F.sequence(F.col(_CHUNK), last)))
            .withColumn(_CTX, F.col("__lb_copy") != F.col(_CHUNK))
            .withColumn(_CHUNK, F.col("__lb_copy"))
            .drop("__lb_copy"))
    if with_prev:
        # what lies before each chunk, from a per-chunk aggregate
        per_chunk = chunk_totals(joined.filter(is_hot), entity)
        # a join on the keys of the windows; Spark decides from the size how
        rows = rows.join(per_chunk.select(entity, _CHUNK, _PREV, "__lb_rows"), on=[entity, _CHUNK], how="left")
    return rows.drop("__lb_lo", "__lb_len", "__lb_last")


def chunk_totals(hot: DataFrame, entity: str) -> DataFrame:
    """(entity, chunk, own rows, rows before the chunk, newest time before it) of split entities."""
    wc = Window.partitionBy(entity).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = hot.groupBy(entity, _CHUNK).agg(F.max(_US).alias("__mx"), F.count(F.lit(1)).alias("__lb_own"))
    return totals.select(entity, _CHUNK, "__lb_own", F.coalesce(F.sum("__lb_own").over(wc), F.lit(0)).alias("__lb_rows"),
                         F.max("__mx").over(wc).alias(_PREV))


# ---------------------------------------------------------------------------
# public operator
# ---------------------------------------------------------------------------

def add_lookback_features(df: DataFrame, spec: LookbackSpec, skew: SkewPolicy | None = None) -> DataFrame:
    """Append 14 look-back features per interval to every row of ``df``.

    Output columns: the input columns without the label, the features in
    ``feature_names`` order, the label last (when ``spec.label`` is set).
    """
    for c in (spec.entity, spec.time, spec.value):
        if c not in df.columns:
            raise ValueError(f"column {c!r} not in {df.columns}")
    skew = skew or SkewPolicy()
    dtype = df.schema[spec.time].dataType
    keep = [c for c in df.columns if c != spec.label]
    base = df.withColumn(_US, epoch_micros(spec.time, dtype)).withColumn(_V, F.col(spec.value))
    names = feature_names(spec.value, spec.intervals)
    tail = [spec.label] if spec.label else []
    context_us = max(spec.intervals) * D

    plan = _split_plan(base, spec.entity, context_us, skew) if skew.enabled else None
    split = plan is not None
    partition = [spec.entity] + [_CHUNK] * split
    if spec.profile == "train":
        return _train_features(base, spec, plan, context_us, keep, skew)
    if spec.profile == "serve":
        base = base.withColumn(_DAY, F.floor((F.col(_US) + F.lit(D // 2)) / F.lit(D)))
    if not split:
        return _features(base.withColumns(_row_columns(Window.partitionBy(spec.entity).orderBy(_US))), spec, partition, keep, [], False)
    rows = _with_chunks(base, spec.entity, context_us, plan, with_prev=spec.profile == "canonical")
    rows = rows.withColumns(_row_columns(Window.partitionBy(*partition).orderBy(_US)))
    out = _features(rows, spec, partition, keep, [_CTX], spec.profile == "canonical")
    return out.filter(~F.col(_CTX)).drop(_CTX)


def _train_features(base: DataFrame, spec: LookbackSpec, plan: DataFrame | None, context_us: int, keep: list[str], skew: SkewPolicy) -> DataFrame:
    # rows in one total order, so ties don't follow the input's order; the frames
    # by time reuse that sort
    plain = [f.name for f in base.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in (_US, _V)]
    tie = [F.col(spec.tie)] if spec.tie else [F.col(_V), F.xxhash64(*plain)]
    base = base.withColumns({f"__lb_tie{i}": c for i, c in enumerate(tie)})
    tie = [f"__lb_tie{i}" for i in range(len(tie))]
    partition = [spec.entity]
    if plan is not None:
        partition.append(_CHUNK)
        oldest = (base.join(plan, on=spec.entity, how="left_semi").groupBy(spec.entity)
                  .agg(F.min(_US).alias("__lb_oldest"), F.min_by(_V, F.struct(_US, *tie)).alias("__lb_first_v")))
        rows = _with_chunks(base, spec.entity, context_us, plan, with_prev=True).join(oldest, on=spec.entity, how="left")
        rows = rows.unionByName(_slices(base, spec.entity, context_us, plan, skew), allowMissingColumns=True)
    else:
        rows = base
    order = Window.partitionBy(*partition).orderBy(_US, *tie)
    rows = rows.withColumns({**_row_columns(order, split=plan is not None), "__first_v": F.first(_V).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    extra = [_GP] if plan is None else [_GP, _CTX, "__lb_sn"]
    out = _features(rows, spec, partition, keep, extra, plan is not None)
    if plan is not None:
        out = out.filter(~F.col(_CTX) & F.col("__lb_sn").isNull())
    # the trainer drops the oldest row of every entity (and so single-row entities)
    return out.filter(F.col(_GP) >= 0).drop(*extra)


def _slices(base: DataFrame, entity: str, context_us: int, plan: DataFrame, skew: SkewPolicy) -> DataFrame:
    """Rows that lead each chunk of a split entity: the earlier gaps its medians can fall on."""
    own = _with_chunks(base.select(entity, _US), entity, context_us, plan, with_prev=True).filter(F.col(_PREV).isNotNull() | (F.col("__lb_rows") == 0))
    own = own.filter(~F.col(_CTX))
    totals = own.groupBy(entity, _CHUNK).agg(F.count(F.lit(1)).alias("__lb_own"), F.max("__lb_rows").alias("__lb_rows"))
    w = Window.partitionBy(entity, _CHUNK).orderBy(_US)
    gap = F.coalesce(F.col(_US) - F.lag(_US).over(w), F.col(_US) - F.col(_PREV))
    gaps = own.select(entity, _CHUNK, gap.alias("gap")).filter("gap is not null")
    ensure_checkpoint_dir(base.sparkSession)
    found = prefix_slices(gaps, totals.select(entity, _CHUNK, "__lb_own", F.greatest(F.col("__lb_rows") - 1, F.lit(0)).alias("__lb_gaps")),
                          entity, _CHUNK, skew.rows_per_task)
    return found.withColumn(_CTX, F.lit(False))
