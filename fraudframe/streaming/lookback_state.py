"""Look-back features of arriving transactions with keyed state (survey J3-J5).

``stream_lookback`` groups a streaming DataFrame by a hash of the entity into ``buckets`` and keeps, per
bucket, the (entity, microseconds, value) history newer than the watermark less
``max(K)`` days and the newest time of what was trimmed of each entity; a bucket's entities are worked on
together, since a call costs about 1.5 ms however few rows it has.  Each micro-batch's
rows get the same 14 features per interval as the batch operator computes
(``canonical`` or ``serve`` profile), then join the history.  The history
is trimmed on every update; an event-time timeout empties it when a
bucket has been idle for longer than it can matter (the canonical profile
keeps one number per entity, the newest time, for the gap to the previous row).
``write_seed`` prepares a stored history that fills the state at the start.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fraudframe.functions.columns import epoch_micros
from fraudframe.functions.ranges import RangeOrder, midpoint, range_moments
from fraudframe.operators.frames import ROWS, median_of_days
from fraudframe.operators.lookback import LookbackSpec, feature_names

D = 86_400_000_000
#: No time: before all others.
NEVER = np.iinfo(np.int64).min
# Arrow streams, so nothing is converted element by element: history rows (card, us, v) and the
# newest time that was trimmed of a card (card, us)
STATE_SCHEMA = T.StructType([
    T.StructField("history", T.BinaryType()),
    T.StructField("before", T.BinaryType()),
])
#: Groups that a stream's entities are dealt to.
BUCKETS = 256


def _sdiv(a, b):
    b = np.asarray(b, dtype=float)
    with np.errstate(all="ignore"):
        return np.where(b != 0, np.asarray(a, dtype=float) / np.where(b != 0, b, 1.0), 0.0)


def features_block(all_us: np.ndarray, all_v: np.ndarray, newest_state: int | None, t: np.ndarray,
                   v: np.ndarray, intervals, profile: str) -> np.ndarray:
    """Features (rows x columns) of the rows (t, v) of one entity: ``all_us`` (sorted) and ``all_v``
    hold the kept history and the rows themselves."""
    newest = np.array([NEVER if newest_state is None else newest_state], np.int64)
    return features_of_cards(np.zeros(len(all_us), np.int64), all_us, all_v, newest, np.zeros(len(t), np.int64), t, v, intervals, profile)


def features_of_cards(card: np.ndarray, all_us: np.ndarray, all_v: np.ndarray, newest: np.ndarray, own: np.ndarray, t: np.ndarray,
                      v: np.ndarray, intervals, profile: str) -> np.ndarray:
    """Features (rows x columns) of the rows (own, t, v) of several entities, numbered from 0: ``all_us`` and ``all_v``, sorted
    by ``card`` and time, hold the kept histories and the rows themselves; ``newest`` has each entity's newest trimmed time
    (NEVER without one).  Windows are ranges of positions, so memory follows the rows and not rows x window."""
    n = len(t)
    # times of one entity after another, further apart than any window is long
    base = int(all_us.min()) if len(all_us) else 0
    width = (int(all_us.max()) - base if len(all_us) else 0) + (max(intervals) + 1) * D + 2
    fit = max(1, (1 << 62) // width)
    if len(newest) > fit:
        out = np.zeros((n, 14 * len(intervals)))
        for c in range(0, len(newest), fit):
            a, b = np.searchsorted(card, [c, c + fit])
            rows = np.flatnonzero((own >= c) & (own < c + fit))
            if len(rows):
                out[rows] = features_of_cards(card[a:b] - c, all_us[a:b], all_v[a:b], newest[c:c + fit], own[rows] - c, t[rows], v[rows], intervals, profile)
        return out
    real, all_us, known_t, t = all_us, card * width + (all_us - base), t, own * width + (t - base)
    hi = np.searchsorted(all_us, t, side="left")
    begin = np.searchsorted(card, own, side="left")
    prev = np.where(hi > begin, real[np.maximum(hi - 1, 0)], NEVER)
    prev = np.where(newest[own] < known_t, np.maximum(prev, newest[own]), prev)
    has_prior = prev > NEVER
    since = known_t - np.where(has_prior, prev, known_t)
    n_today = 1 + hi - np.searchsorted(all_us, t - D, side="right")
    has_value = ~np.isnan(all_v)
    at, all_v = np.r_[0, np.cumsum(has_value)], all_v[has_value]
    values, gaps = RangeOrder(all_v), RangeOrder(np.diff(all_us))
    day = (real + D // 2) // D
    begins = np.flatnonzero(np.r_[True, (day[1:] != day[:-1]) | (card[1:] != card[:-1])]) if len(day) else np.zeros(0, np.int64)
    ends = np.r_[begins[1:], len(day)]
    run = np.searchsorted(begins, np.searchsorted(all_us, t, side="right") - 1, side="right") - 1
    first = all_us[np.minimum(hi, len(all_us) - 1)]
    cols = []
    for k in intervals:
        lo = np.searchsorted(all_us, t - k * D, side="right")
        cnt = hi - lo
        lo_v, hi_v = at[lo], at[hi]
        n_v = hi_v - lo_v
        a, m2 = range_moments(all_v, lo_v, hi_v)
        oldest = np.where(cnt > 0, all_us[np.minimum(lo, len(all_us) - 1)], first)
        if profile == "canonical":
            m = values.median(lo_v, hi_v)
            s = np.where(n_v >= 2, np.sqrt(m2 / np.maximum(n_v - 1, 1)), 0.0)
            buckets = np.sort(np.stack([np.searchsorted(all_us, t - i * D, side="left") -
                                        np.searchsorted(all_us, t - (i + 1) * D, side="right") for i in range(k)], 1), axis=1)
            an, mn = buckets.mean(1), midpoint(buckets[:, (k - 1) // 2], buckets[:, k // 2])
            g = since / D
            ag = np.where(cnt >= 2, (all_us[np.maximum(hi - 1, 0)] - oldest) / D / np.maximum(cnt - 1, 1), 0.0)
            mg = gaps.median(lo, np.maximum(hi - 1, lo)) / D
            known = has_prior
        else:
            own = a + (v - a) / (n_v + 1)
            m2 = m2 + (v - a) * (v - own)
            m = values.median_with(lo_v, hi_v, v)
            s = np.where(n_v > 0, np.sqrt(np.maximum(m2, 0.0) / np.maximum(n_v, 1)), 0.0)
            a = own
            gap = t - all_us[np.maximum(hi - 1, 0)]
            g, ag = gap / D, (t - oldest) / D / np.maximum(cnt, 1)
            mg = gaps.median_with(lo, np.maximum(hi - 1, lo), gap) / D
            an = (cnt + 1) / k
            mn = np.concatenate([median_of_days(lo[i:i + ROWS], hi[i:i + ROWS], run[i:i + ROWS], begins, ends, k) for i in range(0, n, ROWS)])
            known = cnt > 0
        block = [_sdiv(v, a), v - a, _sdiv(v, m), v - m, _sdiv(v - a, s), v - a - s,
                 _sdiv(n_today, an), n_today - an, _sdiv(n_today, mn), n_today - mn,
                 _sdiv(ag, g), ag - g, _sdiv(mg, g), mg - g]
        cols += [np.where(known, c, 0.0) for c in block]
    return np.stack(cols, 1) if cols else np.zeros((n, 0))


def _state_fn(spec: LookbackSpec, out_cols: list[str]):
    intervals, profile = spec.intervals, spec.profile
    names_of = feature_names(spec.value, intervals)
    reach = max(intervals) * D

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # idle bucket: its history can no longer fall in any window.  The
            # canonical gap to the previous row still needs the newest times,
            # so only these stay.
            if profile == "canonical":
                history, before = (_read(b) for b in state.get)
                code, names = _codes([history["card"], before["card"]])
                newest = np.full(len(names), NEVER)
                np.maximum.at(newest, code, np.concatenate([history["us"], before["us"]]))
                state.update((b"", _write(card=names, us=newest)))
            else:
                state.remove()
            return
        parts = list(pdfs)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        history, before = (_read(b) for b in state.get) if state.exists else (_read(b""), _read(b""))
        code, names = _codes([history["card"], batch["__card"].to_numpy(object), before["card"]])
        old, new = len(history["us"]), len(history["us"]) + len(batch)
        newest = np.full(len(names), NEVER)
        newest[code[new:]] = before["us"]
        own, code = code[old:new], code[:new]
        all_us = np.concatenate([history["us"], batch["__us"].to_numpy(np.int64)])
        all_v = np.concatenate([history["v"], batch["__v"].to_numpy(float)])
        order = np.lexsort((all_us, code))
        code, all_us, all_v = code[order], all_us[order], all_v[order]
        live = ~batch["__seed"].to_numpy(bool)
        if live.any():
            rows = batch[live]
            feats = features_of_cards(code, all_us, all_v, newest, own[live], rows["__us"].to_numpy(np.int64), rows["__v"].to_numpy(float),
                                      intervals, profile)
            fpos = {nm: i for i, nm in enumerate(names_of)}
            yield pd.DataFrame({c: (feats[:, fpos[c]] if c in fpos else rows[c].to_numpy()) for c in out_cols})
        # no later batch accepts a row older than this batch's watermark, so
        # nothing at or before watermark - max(K) days is in a window again
        mark = state.getCurrentWatermarkMs()
        keep = all_us > mark * 1000 - reach
        last = int(all_us.max())
        if not keep.all():
            np.maximum.at(newest, code[~keep], all_us[~keep])
            code, all_us, all_v = code[keep], all_us[keep], all_v[keep]
        # the serve profile asks for no time before its windows
        some = np.flatnonzero(newest > NEVER) if profile == "canonical" else np.zeros(0, np.int64)
        state.update((_write(card=names[code], us=all_us, v=all_v), _write(card=names[some], us=newest[some])))
        state.setTimeoutTimestamp(max((last + reach) // 1000, mark) + 1)

    return fn


def _codes(cards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the entities and the entity of each; rows without one are one more."""
    code, names = pd.factorize(np.concatenate(cards).astype(object), use_na_sentinel=False)
    return code.astype(np.int64), np.where(pd.isna(names), None, names)


def _write(**columns) -> bytes:
    table = pa.table({c: pa.array(v, pa.string()) if c == "card" else pa.array(v) for c, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> dict[str, np.ndarray]:
    if not data:
        return {"card": np.zeros(0, object), "us": np.zeros(0, np.int64), "v": np.zeros(0)}
    table = pa.ipc.open_stream(data).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def write_seed(history: DataFrame, spec: LookbackSpec, path: str, lateness: str = "1 day") -> None:
    """Write what a stream needs of the stored ``history`` to ``path``: the
    rows that a window of a new row can reach, and the newest time of every
    entity that has none.  Rows without a time are left out.  One map-side
    combined aggregate per entity; the history itself is not shuffled."""
    rows = history.select(spec.entity, epoch_micros(spec.time, history.schema[spec.time].dataType).alias("__us"),
                          F.col(spec.value).cast("double").alias("__v")).filter(F.col("__us").isNotNull())
    oldest = F.unix_micros(F.timestamp_micros(F.max("__us")) - F.expr(f"INTERVAL {lateness}"))
    oldest = rows.agg(oldest.alias("t")).first()["t"] or 0
    cut = oldest - (max(spec.intervals) + 1) * D  # a day more than needed
    idle = (rows.groupBy(spec.entity).agg(F.max("__us").alias("__us")).filter(F.col("__us") <= cut)
            .withColumn("__v", F.lit(None).cast("double")))
    rows.filter(F.col("__us") > cut).unionByName(idle).write.mode("overwrite").parquet(path)


def stream_lookback(stream: DataFrame, spec: LookbackSpec, key_col: str, lateness: str = "1 day",
                    seed: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming DataFrame of input rows with their look-back features.

    ``lateness`` is the watermark delay on the event time.  The history kept
    follows the watermark, so every row that the engine accepts sees its whole
    window; rows older than the watermark are dropped by the engine and counted
    in ``numRowsDroppedByWatermark`` of the query's progress (``streaming.late`` writes them
    to a table of their own).  ``seed`` is a
    folder of ``write_seed``: its rows fill the state in the first micro-batch
    and are not returned; they must not come again in the stream.  ``buckets`` must stay the
    same as long as a checkpoint is used; a call holds the rows of a bucket in the micro-batch and its history."""
    if spec.profile == "train":
        raise ValueError("the train profile needs every earlier row; stream with canonical or serve")
    if spec.label and spec.label not in stream.columns:  # new records carry no label
        spec = replace(spec, label=None)
    dtype = stream.schema[spec.time].dataType
    event_ts = "__event_ts"
    df = (stream.withColumn("__us", epoch_micros(spec.time, dtype))
          .withColumn("__v", F.col(spec.value).cast("double"))
          .withColumn("__seed", F.lit(False)))
    if seed is not None:
        spark = stream.sparkSession
        entity = stream.schema[spec.entity].dataType
        past = spark.readStream.schema(spark.read.parquet(seed).schema).parquet(seed).withColumn("__seed", F.lit(True))
        past = past.withColumn(spec.entity, F.col(spec.entity).cast(entity))
        df = df.unionByName(past, allowMissingColumns=True)
    entity = F.col(spec.entity)
    if isinstance(stream.schema[spec.entity].dataType, (T.DoubleType, T.FloatType)):
        entity = entity + F.lit(0.0).cast(stream.schema[spec.entity].dataType)      # both zeros are one entity
    df = df.withColumn("__card", entity.cast("string"))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64("__card"), F.lit(buckets)).cast("int"))
    df = df.withColumn(event_ts, F.timestamp_micros(F.col("__us"))).withWatermark(event_ts, lateness)
    keep_cols = [c for c in stream.columns if c != spec.label] + ([spec.label] if spec.label else [])
    names = feature_names(spec.value, spec.intervals)
    out_fields = [stream.schema[c] for c in keep_cols if c != spec.label] + \
        [T.StructField(n, T.DoubleType()) for n in names] + \
        ([stream.schema[spec.label]] if spec.label else [])
    out_schema = T.StructType(out_fields)
    fn = _state_fn(spec, [f.name for f in out_fields])
    return df.groupBy("__bucket").applyInPandasWithState(
        fn, out_schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
