"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the
generated tables, and most have an equivalent DuckDB SQL text (the oracle).

Column names of a query and of its SQL are equal; computed doubles are
snapped to a binary grid of 2**-20 (about 1e-6) on both sides, so that
summation order does not matter and no engine-specific decimal rounding is
involved.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudframe.functions.sketches import sketch_ranks
from fraudframe.operators.lookback import LookbackSpec, add_lookback_features, feature_names
from fraudframe.plans import lookback_sql
from fraudframe.sources.testdata import EVENT_TRANSACTIONS_SQL, event_transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 20  # bits of the binary snapping grid


def snap(c) -> "F.Column":
    scale = float(1 << DIGITS)
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def snap_sql(expr: str) -> str:
    return lookback_sql.snap_sql(expr, DIGITS)


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _rounded(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keep, *[snap(c).alias(c) for c in cols])


# --------------------------------------------------------------------------
# D: look-back features over events (entity = card_number, value = amount)
# --------------------------------------------------------------------------

_LB_SRC = f"SELECT id, card_number AS card, epoch_us(ts) AS us, amount AS v FROM ({EVENT_TRANSACTIONS_SQL}) t"


def _lookback_query(profile: str, intervals: tuple[int, ...], only: slice | None = None) -> Query:
    names = feature_names("amount", intervals)
    chosen = names[only] if only else names

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount")
        spec = LookbackSpec("card_number", "ts", "amount", intervals, profile=profile)
        return _rounded(add_lookback_features(tx, spec), ["id"], chosen)

    return run


def _lookback_oracle(fn, intervals, only: slice | None = None) -> str:
    sql = fn(_LB_SRC, "amount", intervals, DIGITS)
    if only is None:
        return sql
    names = feature_names("amount", intervals)[only]
    return f"SELECT id, {', '.join(names)} FROM ({sql}) q"


register("lookback_value_3", _lookback_oracle(lookback_sql.canonical_sql, (3,), slice(0, 6)))(
    _lookback_query("canonical", (3,), slice(0, 6)))
register("lookback_canonical", _lookback_oracle(lookback_sql.canonical_sql, (3, 7)))(
    _lookback_query("canonical", (3, 7)))
register("lookback_train", _lookback_oracle(lookback_sql.train_sql, (3, 7)))(
    _lookback_query("train", (3, 7)))
register("lookback_serve", _lookback_oracle(lookback_sql.serve_sql, (3, 7)))(
    _lookback_query("serve", (3, 7)))


# --------------------------------------------------------------------------
# A, B: scans and profiling
# --------------------------------------------------------------------------

from fraudframe.operators.encode import dense_index, encode, split_bad_rows  # noqa: E402
from fraudframe.operators.profile import label_candidates, profile_frame  # noqa: E402
from fraudframe.plans.spec import EncodingPlan  # noqa: E402
from fraudframe.sources.tables import page  # noqa: E402
from fraudframe.sources.testdata import table  # noqa: E402

_TX_COLS = [("id", "int"), ("card_number", "varchar"), ("ts", "datetime"), ("amount", "float"),
            ("vendor_code", "varchar"), ("event_type", "varchar"), ("fraud", "int")]


def _profile_sql(src: str, cols, key: str | None) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        if t in ("int", "float"):
            ones, zeros = f"count_if({c} = 1)", f"count_if({c} = 0)"
        elif t == "varchar":
            ones, zeros = f"count_if({c} = '1')", f"count_if({c} = '0')"
        else:
            ones, zeros = "0", "0"
        if t == "varchar":
            dig = f"count_if(NOT coalesce(regexp_full_match({c}, '[0-9]+'), false)) = 0"
            s = f"regexp_replace({c}, '^0+(.)', '\\1')"
            big = (f"count_if(coalesce(regexp_full_match({c}, '[0-9]+'), false) AND (length({s}) > 10 OR "
                   f"(length({s}) = 10 AND {s} > '2147483647'))) = 0")
            fits = f"({dig}) AND ({big})"
        else:
            dig, fits = "false", "false"
        keyc = (f"count(DISTINCT {c}) = count(*) AND count_if({c} IS NULL) = 0" if c == key else "false")
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, '{t}' AS type, count(*) AS n_rows, "
            f"count_if({c} IS NULL) AS n_null, {ones} AS ones, {zeros} AS zeros, {dig} AS all_digits, "
            f"{fits} AS fits_int, {keyc} AS is_key FROM ({src}) s")
    u = " UNION ALL ".join(parts)
    return (f"SELECT position, name, type, n_rows, n_null, ones, zeros, "
            f"(ones + zeros = n_rows AND ones > 0 AND zeros > 0) AS is_label_candidate, all_digits, fits_int, "
            f"concat_ws(',', CASE WHEN all_digits THEN 'float' END, CASE WHEN fits_int THEN 'int' END) AS applicable, "
            f"is_key FROM ({u}) p")


@register("profile_columns", _profile_sql(EVENT_TRANSACTIONS_SQL, _TX_COLS, "id"))
def q_profile_columns(spark, sf_dir):
    p = profile_frame(event_transactions(spark, sf_dir), "id")
    return p.withColumn("applicable", F.concat_ws(",", "applicable"))


_LABELS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count_if({c} = 1) AS fraud_number, count_if({c} = 0) AS no_fraud_number, "
    f"count(*) AS n FROM labels" for c in ("doc_id", "quality", "toxic"))


@register("label_candidates", f"SELECT name, fraud_number, no_fraud_number FROM ({_LABELS_SQL}) s "
                              f"WHERE fraud_number + no_fraud_number = n AND fraud_number > 0 AND no_fraud_number > 0")
def q_label_candidates(spark, sf_dir):
    return label_candidates(profile_frame(table(spark, sf_dir, "labels")))


@register("page_scan", f"SELECT id, card_number, strftime(ts, '%Y-%m-%d %H:%M:%S:%f') AS ts, amount "
                       f"FROM ({EVENT_TRANSACTIONS_SQL}) t ORDER BY id LIMIT 50 OFFSET 100")
def q_page_scan(spark, sf_dir):
    tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount")
    return page(tx, "id", limit=50, offset=100)


# --------------------------------------------------------------------------
# C: encoding
# --------------------------------------------------------------------------

EVENTS_PLAN = EncodingPlan(
    "events", "ts",
    {"card_number": "float", "ts": "julian", "vendor_code": "int", "event_type": "label_encoder",
     "fraud": "fraud_type"},
    entity="card_number", key="id")

_JD = "(epoch_us(ts) / CAST(86400000000 AS DOUBLE) + 2440587.5)"


@register("encode_events", f"""
SELECT id, card_number AS _entity, epoch_us(ts) AS _us, CAST(card_number AS DOUBLE) AS card_number,
       {_JD} AS ts, amount, CAST(CAST(vendor_code AS BIGINT) AS DOUBLE) AS vendor_code,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type, CAST(fraud AS DOUBLE) AS fraud
FROM ({EVENT_TRANSACTIONS_SQL}) t""")
def q_encode_events(spark, sf_dir):
    out, _ = encode(event_transactions(spark, sf_dir), EVENTS_PLAN)
    return out


@register("label_dictionary", f"SELECT card_number, dense_rank() OVER (ORDER BY card_number) - 1 AS code "
                              f"FROM (SELECT DISTINCT card_number FROM ({EVENT_TRANSACTIONS_SQL}) t) d")
def q_label_dictionary(spark, sf_dir):
    return dense_index(event_transactions(spark, sf_dir), "card_number")


@register("julian_date", f"SELECT event_id, {_JD} AS julian "
                         f"FROM events")
def q_julian_date(spark, sf_dir):
    from fraudframe.functions.columns import epoch_micros, julian_date
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", julian_date(epoch_micros("ts", ev.schema["ts"].dataType)).alias("julian"))


_CONTRACT = {"card_number": "int", "ts": "datetime", "amount": "float", "vendor_code": "int",
             "event_type": "varchar"}


@register("reject_bad_rows", f"""
SELECT reason AS reject_reason, count(*) AS n FROM (
  SELECT coalesce(
    CASE WHEN card_number IS NULL THEN 'card_number: missing'
         WHEN TRY_CAST(card_number AS BIGINT) IS NULL THEN 'card_number: not int' END,
    CASE WHEN ts IS NULL THEN 'ts: missing' END,
    CASE WHEN amount IS NULL THEN 'amount: missing' END,
    CASE WHEN vendor_code IS NULL THEN 'vendor_code: missing'
         WHEN TRY_CAST(vendor_code AS BIGINT) IS NULL THEN 'vendor_code: not int' END,
    CASE WHEN event_type IS NULL THEN 'event_type: missing' END) AS reason
  FROM ({EVENT_TRANSACTIONS_SQL}) t) r GROUP BY reason""")
def q_reject_bad_rows(spark, sf_dir):
    checked = split_bad_rows(event_transactions(spark, sf_dir), _CONTRACT)
    return checked.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


# the same contract on rows that break it: cards missing for one kind of event,
# vendor codes that are no numbers for another
_DIRTY_SQL = f"""SELECT id, CASE WHEN event_type <> 'click' THEN card_number END AS card_number, ts, amount,
  CASE WHEN event_type = 'error' THEN vendor_code || 'x' ELSE vendor_code END AS vendor_code, event_type
FROM ({EVENT_TRANSACTIONS_SQL}) t"""


@register("reject_dirty_rows", f"""
SELECT id, coalesce(CASE WHEN card_number IS NULL THEN 'card_number: missing' END,
                    CASE WHEN TRY_CAST(vendor_code AS BIGINT) IS NULL THEN 'vendor_code: not int' END) AS reject_reason
FROM ({_DIRTY_SQL}) d""")
def q_reject_dirty_rows(spark, sf_dir):
    dirty = event_transactions(spark, sf_dir).withColumns({
        "card_number": F.when(F.col("event_type") != "click", F.col("card_number")),
        "vendor_code": F.when(F.col("event_type") == "error", F.concat("vendor_code", F.lit("x"))).otherwise(F.col("vendor_code"))})
    return split_bad_rows(dirty, _CONTRACT).select("id", "reject_reason")


# --------------------------------------------------------------------------
# I: metrics of a rule-based prediction (amount above the card's 3-day mean)
# --------------------------------------------------------------------------

from fraudframe.operators.metrics import binary_metrics, metrics_sql  # noqa: E402
from fraudframe.operators.scale import scale  # noqa: E402


def _rule_predictions(spark, sf_dir) -> DataFrame:
    tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount", "fraud")
    spec = LookbackSpec("card_number", "ts", "amount", (3,), label="fraud")
    f = add_lookback_features(tx, spec)
    return f.select("fraud", (F.col("amount_current_minus_average_3") > 0).cast("int").alias("prediction"))


_RULE_SQL = (f"SELECT l.fraud, CAST(f.amount_current_minus_average_3 > 0 AS INTEGER) AS prediction "
             f"FROM ({lookback_sql.canonical_sql(_LB_SRC, 'amount', (3,), None)}) f "
             f"JOIN ({EVENT_TRANSACTIONS_SQL}) l ON f.id = l.id")


def _metrics_query(convention):
    def run(spark, sf_dir):
        m = binary_metrics(_rule_predictions(spark, sf_dir), "fraud", "prediction", convention)
        return m.select(*[snap(c).alias(c) for c in m.columns])
    return run


def _metrics_oracle(convention):
    sql = metrics_sql(_RULE_SQL, "fraud", "prediction", convention)
    from fraudframe.operators.metrics import METRIC_COLUMNS
    return f"SELECT {', '.join(f'{snap_sql(c)} AS {c}' for c in METRIC_COLUMNS)} FROM ({sql}) m"


register("metrics_standard", _metrics_oracle("standard"))(_metrics_query("standard"))
register("metrics_reference", _metrics_oracle("reference"))(_metrics_query("reference"))


# --------------------------------------------------------------------------
# F: scalers over two event columns (amount, vendor code as a number)
# --------------------------------------------------------------------------

_SC_SRC = f"SELECT id, amount AS x1, CAST(vendor_code AS DOUBLE) AS x2 FROM ({EVENT_TRANSACTIONS_SQL}) t"


def _scale_frame(spark, sf_dir) -> DataFrame:
    tx = event_transactions(spark, sf_dir)
    return tx.select("id", F.col("amount").alias("x1"), F.col("vendor_code").cast("double").alias("x2"))


def _scale_query(kind):
    def run(spark, sf_dir):
        out = scale(_scale_frame(spark, sf_dir), ["x1", "x2"], kind)
        return out.select("id", *[snap(c).alias(c) for c in ("x1", "x2")])
    return run


def _scale_sql(center: str, spread: str) -> str:
    def one(c):
        cen, spr = center.format(c=c), spread.format(c=c)
        expr = f"(s.{c} - a.{c}_c) / (CASE WHEN a.{c}_s = 0 OR a.{c}_s IS NULL THEN 1 ELSE a.{c}_s END)"
        return f"{snap_sql(expr)} AS {c}", f"{cen} AS {c}_c, {spr} AS {c}_s"
    sel, agg = zip(*(one(c) for c in ("x1", "x2")))
    return (f"SELECT s.id, {', '.join(sel)} FROM ({_SC_SRC}) s, "
            f"(SELECT {', '.join(agg)} FROM ({_SC_SRC}) t) a")


for _kind, _c, _s in (
        ("standard", "avg({c})", "stddev_pop({c})"),
        ("min_max", "min({c})", "max({c}) - min({c})"),
        ("max_abs", "0.0", "max(abs({c}))"),
        ("robust", "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")):
    register(f"scale_{_kind}", _scale_sql(_c, _s))(_scale_query(_kind))

register("normalize_l2", f"""
SELECT id, {snap_sql("x1 / n")} AS x1, {snap_sql("x2 / n")} AS x2
FROM (SELECT id, x1, x2, CASE WHEN sqrt(x1 * x1 + x2 * x2) = 0 THEN 1 ELSE sqrt(x1 * x1 + x2 * x2) END AS n
      FROM ({_SC_SRC}) s) t""")(_scale_query("normalizer"))


def _quantile_map_sql() -> str:
    """Both columns through their empirical distribution: the mean of interpolating from the last grid value that is not
    above and from the first that is not below."""
    grid = ", ".join(f"""
d_{c} AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM s),
p_{c} AS (SELECT i, i / (k - 1.0) * (n - 1) AS pos, 1.0 / (k - 1) AS step FROM
  (SELECT n, least(1000, n) AS k FROM (SELECT count(*) AS n FROM s) t) u, range(1000) r(i) WHERE i < k),
g_{c} AS (SELECT p.i, p.step, lo.x + (hi.x - lo.x) * (p.pos - floor(p.pos)) AS q FROM p_{c} p
  JOIN d_{c} lo ON lo.r = CAST(floor(p.pos) AS BIGINT) JOIN d_{c} hi ON hi.r = CAST(ceil(p.pos) AS BIGINT)),
l_{c} AS (SELECT q, min(i) AS i0, max(i) AS i1, any_value(step) AS step FROM g_{c} GROUP BY q),
n_{c} AS (SELECT q, i0, i1, step, lead(q) OVER (ORDER BY q) AS q2 FROM l_{c})""" for c in ("x1", "x2"))

    def value(c):
        a = f"a_{c}"
        return (f"CASE WHEN s.{c} = {a}.q AND {a}.i0 = 0 THEN 0.0 WHEN s.{c} = {a}.q AND {a}.q2 IS NULL THEN 1.0 "
                f"WHEN s.{c} = {a}.q THEN ({a}.i0 + {a}.i1) * {a}.step / 2 "
                f"ELSE {a}.i1 * {a}.step + (s.{c} - {a}.q) / ({a}.q2 - {a}.q) * {a}.step END")

    return f"""WITH s AS ({_SC_SRC}), {grid}
SELECT s.id, {snap_sql(value("x1"))} AS x1, {snap_sql(value("x2"))} AS x2
FROM s ASOF JOIN n_x1 a_x1 ON s.x1 >= a_x1.q ASOF JOIN n_x2 a_x2 ON s.x2 >= a_x2.q"""


register("scale_quantile_uniform", _quantile_map_sql())(_scale_query("quantile_uniform"))
register("scale_quantile_normal")(_scale_query("quantile_normal"))

#: Levels at which the sketches' values are held against exact ranks, and the share of the rows that they may miss.
SKETCH_LEVELS, SKETCH_OFF = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0), 0.001


@register("quantile_sketch_ranks", f"""
SELECT c.name AS "column", l.level AS level, c.n AS n, TRUE AS within
FROM (SELECT 'x1' AS name, count(x1) AS n FROM ({_SC_SRC}) t UNION ALL SELECT 'x2', count(x2) FROM ({_SC_SRC}) t) c,
     (SELECT unnest([{", ".join(f"CAST({p} AS DOUBLE)" for p in SKETCH_LEVELS)}]) AS level) l""")
def quantile_sketch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of two columns from sketches; their ranks counted exactly stay within the stated error."""
    off = sketch_ranks(_scale_frame(spark, sf_dir), ["x1", "x2"], list(SKETCH_LEVELS))
    return off.select("column", "level", "n", (F.col("rank_off") <= SKETCH_OFF).alias("within"))


# --------------------------------------------------------------------------
# E: split and resampling (exact counts), H3: k nearest neighbours
# --------------------------------------------------------------------------

from fraudframe.operators import knn as _knn  # noqa: E402
from fraudframe.operators.resample import over_sample, split_train_test, under_sample  # noqa: E402

_TX = f"({EVENT_TRANSACTIONS_SQL}) t"


@register("split_counts", f"""
SELECT is_test, n FROM (
  SELECT true AS is_test, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n FROM {_TX}
  UNION ALL SELECT false AS is_test, count(*) - CAST(ceil(count(*) * 0.25) AS BIGINT) AS n FROM {_TX}) s""")
def q_split_counts(spark, sf_dir):
    s = split_train_test(event_transactions(spark, sf_dir), "id", 0.25, 0)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


_CLASS_N = f"(SELECT count_if(fraud = 1) AS n1, count_if(fraud = 0) AS n0 FROM {_TX}) c"


@register("under_sample_counts", f"""
SELECT fraud, n FROM (SELECT 1 AS fraud, n1 AS n FROM {_CLASS_N}
                      UNION ALL SELECT 0 AS fraud, CAST(floor(n1 / 0.5) AS BIGINT) AS n FROM {_CLASS_N}) s""")
def q_under_sample_counts(spark, sf_dir):
    u = under_sample(event_transactions(spark, sf_dir), "fraud", "id")
    return u.groupBy("fraud").agg(F.count(F.lit(1)).alias("n"))


@register("over_sample_counts", f"""
SELECT fraud, n FROM (SELECT 0 AS fraud, n0 AS n FROM {_CLASS_N}
                      UNION ALL SELECT 1 AS fraud, CAST(floor(0.5 * n0) AS BIGINT) AS n FROM {_CLASS_N}) s""")
def q_over_sample_counts(spark, sf_dir):
    o = over_sample(event_transactions(spark, sf_dir), "fraud", "id")
    return o.groupBy("fraud").agg(F.count(F.lit(1)).alias("n"))


@register("knn_topk", """
SELECT q_vec_id, r_vec_id, nn_rank FROM (
  SELECT a.vec_id AS q_vec_id, b.vec_id AS r_vec_id,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY
           list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS nn_rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) r
WHERE nn_rank <= 5""")
def q_knn_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return _knn.knn(emb, emb, 5, "vec_id", "vec_id", "embedding", exclude_same_id=True) \
        .select("q_vec_id", "r_vec_id", "nn_rank")


# vectors in steps of a half, so that very many distances are equal
@register("knn_topk_ties", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(4 * x::DOUBLE) / 2)[1:12] AS e FROM embeddings)
SELECT q_vec_id, r_vec_id, nn_rank, dist FROM (
  SELECT a.vec_id AS q_vec_id, b.vec_id AS r_vec_id, list_distance(a.e, b.e) AS dist,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS nn_rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id) r
WHERE nn_rank <= 7""")
def q_knn_topk_ties(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    half = emb.select("vec_id", F.slice(F.transform("embedding", lambda x: F.round(4 * x.cast("double")) / 2), 1, 12).alias("e"))
    return _knn.knn(half, half, 7, "vec_id", "vec_id", "e", exclude_same_id=True).select("q_vec_id", "r_vec_id", "nn_rank", "dist")


def _embedding_frame(spark, sf_dir):
    """The frame and its vector columns, as many as every vector has components."""
    emb = table(spark, sf_dir, "embeddings")
    least, most = emb.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components")
    cols = [f"e{i}" for i in range(most or 0)]
    return emb.select("vec_id", (F.col("label") == 0).cast("int").alias("y"),
                      *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@register("smote_enn_counts")
def q_smote_enn_counts(spark, sf_dir):
    df, cols = _embedding_frame(spark, sf_dir)
    out = _knn.smote_enn(df, "vec_id", "y", cols)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# G, H: full fit jobs (rows-only checks): one metrics row per model
# --------------------------------------------------------------------------

from fraudframe.plans.fit_job import fit_job  # noqa: E402
from fraudframe.plans.spec import MODELS, FeatureParams, TrainJob  # noqa: E402
from fraudframe.operators.select import fit_selector  # noqa: E402

FIT_PLAN = EncodingPlan(
    "events", "ts",
    {"card_number": "float", "ts": "julian", "vendor_code": "int", "event_type": "omit", "fraud": "fraud_type"},
    FeatureParams("amount", (3, 7)), entity="card_number", key="id")


def _fit_query(model: int, selector: int = 2, scaler: int = 1, sampler: int = 1):
    def run(spark, sf_dir):
        b = fit_job(event_transactions(spark, sf_dir), FIT_PLAN,
                    TrainJob("events-plan", model=model, selector=selector, scaler=scaler, sampler=sampler))
        return b.metrics.select(F.lit(MODELS[model]).alias("model"), "*")
    return run


for _code in MODELS:
    register(f"fit_{MODELS[_code]}")(_fit_query(_code))
register("fit_smote_enn_logistic")(_fit_query(1, sampler=3))


def _selector_query(kind: str):
    def run(spark, sf_dir):
        from pyspark.ml.feature import VectorAssembler
        df, cols = _embedding_frame(spark, sf_dir)
        a = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
        m = fit_selector(kind, a, "vec_id", "y")
        from pyspark.ml.functions import vector_to_array
        return m.transform(a).select("vec_id", vector_to_array("features").alias("selected"))
    return run


register("select_pca95")(_selector_query("pca_95"))
register("select_svd2")(_selector_query("truncated_svd_2"))
@register("select_rfecv")
def q_select_rfecv(spark, sf_dir):
    """Recursive elimination (5 folds, step 1, 100 trees) over the four
    encoded event columns; returns the kept columns of every row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    enc, _ = encode(event_transactions(spark, sf_dir), EncodingPlan(
        "events", "ts", {"card_number": "float", "ts": "julian", "vendor_code": "int", "event_type": "omit",
                         "fraud": "fraud_type"}, entity="card_number", key="id"))
    cols = ["card_number", "ts", "amount", "vendor_code"]
    a = VectorAssembler(inputCols=cols, outputCol="features").transform(enc.withColumn("fraud", F.col("fraud").cast("int")))
    m = fit_selector("rfecv_random_forest", a, "id", "fraud")
    return m.transform(a).select("id", vector_to_array("features").alias("selected"))


# --------------------------------------------------------------------------
# J: streaming.  The events table is replayed in four time slices, one per
# micro-batch, through the keyed look-back state; the oracle is the batch SQL.
# --------------------------------------------------------------------------

import os  # noqa: E402

from fraudframe.sources.replay import scratch_dir, write_time_slices  # noqa: E402
from fraudframe.streaming.lookback_state import stream_lookback  # noqa: E402


def _replayed_events(spark, sf_dir, name):
    tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount", "fraud")
    base = scratch_dir(spark, name)
    write_time_slices(tx, "ts", os.path.join(base, "src"), 4)
    src = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
    return tx, src, base


@register("stream_lookback", _lookback_oracle(lookback_sql.canonical_sql, (3, 7)))
def q_stream_lookback(spark, sf_dir):
    _, src, base = _replayed_events(spark, sf_dir, "stream-lookback")
    spec = LookbackSpec("card_number", "ts", "amount", (3, 7), label="fraud")
    q = (stream_lookback(src, spec, "id").writeStream.format("parquet")
         .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _rounded(spark.read.parquet(os.path.join(base, "out")), ["id"], feature_names("amount", (3, 7)))


# The rows of the first half of the time fill the state from storage; only the others stream.
@register("stream_seeded", f"""
WITH m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS mid FROM ({EVENT_TRANSACTIONS_SQL}) t)
SELECT q.* FROM ({_lookback_oracle(lookback_sql.canonical_sql, (3, 7))}) q
JOIN (SELECT id, epoch_us(ts) AS us FROM ({EVENT_TRANSACTIONS_SQL}) t) e ON e.id = q.id JOIN m ON e.us > m.mid""")
def q_stream_seeded(spark, sf_dir):
    from fraudframe.functions.columns import epoch_micros
    from fraudframe.streaming.lookback_state import write_seed
    tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount")
    us = epoch_micros("ts", tx.schema["ts"].dataType)
    lo, hi = tx.agg(F.min(us), F.max(us)).first()
    new = us > F.lit((lo + hi) // 2)
    base = scratch_dir(spark, "stream-seeded")
    spec = LookbackSpec("card_number", "ts", "amount", (3, 7))
    write_seed(tx.filter(~new), spec, os.path.join(base, "seed"))
    write_time_slices(tx.filter(new), "ts", os.path.join(base, "src"), 3)
    src = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
    q = (stream_lookback(src, spec, "id", seed=os.path.join(base, "seed")).writeStream.format("parquet")
         .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    return _rounded(spark.read.parquet(os.path.join(base, "out")), ["id"], feature_names("amount", (3, 7)))


# Every ninth event comes in the slice after its own, every fiftieth in the last: with an
# allowed lateness of four days some of them are too late.  The oracle deals them by SQL.
_SLICES, _LATENESS = 4, 4 * 86_400_000_000

_LATE_SQL = f"""
WITH t AS (SELECT id, amount, epoch_us(ts) AS us FROM ({EVENT_TRANSACTIONS_SQL}) e),
w AS (SELECT min(us) AS lo, (max(us) - min(us) + {_SLICES}) // {_SLICES} AS width FROM t),
s AS (
  SELECT id, amount, us, CASE WHEN id % 50 = 0 THEN {_SLICES - 1} WHEN id % 9 = 0 THEN least((us - lo) // width + 1, {_SLICES - 1})
                              ELSE (us - lo) // width END AS slice FROM t, w),
n AS (SELECT slice, max(max(us)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s GROUP BY slice)
SELECT id, amount, coalesce(us < newest - {_LATENESS}, false) AS late, CASE WHEN us < newest - {_LATENESS} THEN newest - us END AS late_by_us
FROM s JOIN n USING (slice)"""


@register("stream_late_rows", _LATE_SQL)
def q_stream_late_rows(spark, sf_dir):
    """Accepted and late rows of a replayed stream; together they are the input."""
    from fraudframe.functions.columns import epoch_micros
    from fraudframe.streaming.late import accepted_stream, late_rows, start_late_router
    tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount")
    us = epoch_micros("ts", tx.schema["ts"].dataType)
    lo, hi = tx.agg(F.min(us), F.max(us)).first()
    own = F.floor((us - F.lit(lo)) / F.lit((hi - lo + _SLICES) // _SLICES)).cast("int")
    last = F.lit(_SLICES - 1)
    slices = tx.withColumn("slice", F.when(F.col("id") % 50 == 0, last).when(F.col("id") % 9 == 0, F.least(own + 1, last)).otherwise(own))
    base = scratch_dir(spark, "stream-late")
    src, accepted, late = (os.path.join(base, n) for n in ("src", "accepted", "late"))
    for i in range(_SLICES):      # each slice is a micro-batch of its own: the query goes on where it was
        slices.filter(F.col("slice") == i).drop("slice").write.mode("append").parquet(src)
        start_late_router(spark.readStream.schema(tx.schema).parquet(src), "ts", accepted, late, os.path.join(base, "ck"), "4 days").awaitTermination()
    # the accepted rows are read by a stateful query that drops none
    feats = stream_lookback(accepted_stream(spark, accepted, tx.schema), LookbackSpec("card_number", "ts", "amount", (3,)), "id", lateness="4 days")
    (feats.writeStream.format("parquet").option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck2"))
     .trigger(availableNow=True).start().awaitTermination())
    kept = spark.read.parquet(os.path.join(base, "out")).select("id", "amount", F.lit(False).alias("late"), F.lit(None).cast("long").alias("late_by_us"))
    return kept.unionByName(late_rows(spark, late).select("id", "amount", F.lit(True).alias("late"), "late_by_us"))


@register("stream_score_all_models")
def q_stream_score(spark, sf_dir):
    """Fit two models on all rows, then score the replayed stream with both
    (long form: one row per event and model)."""
    from fraudframe.streaming.score import ModelRegistry, start_scoring
    tx = event_transactions(spark, sf_dir)
    base = scratch_dir(spark, "stream-score")
    write_time_slices(tx, "ts", os.path.join(base, "src"), 4)
    src = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
    from fraudframe.plans.store import Store
    st = Store(spark, scratch_dir(spark, "store"))      # both jobs read one feature table
    reg = ModelRegistry()
    for code in (1, 5):
        b = fit_job(tx, FIT_PLAN, TrainJob("events-plan", model=code, selector=2, scaler=1, sampler=1), store=st, input_id="events")
        reg.register(MODELS[code], b)
    any_bundle = next(iter(reg.models.values()))
    q = start_scoring(src, any_bundle.encoder, any_bundle.lookback, reg, os.path.join(base, "out"),
                      os.path.join(base, "ck"), contract=_CONTRACT)
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).select(
        "id", "model_id", "prediction", snap("positive_probability").alias("positive_probability"),
        snap("negative_probability").alias("negative_probability"))


# --------------------------------------------------------------------------
# K: runs, estimators, metrics and the leaderboard (rows-only)
# --------------------------------------------------------------------------

@register("leaderboard")
def q_leaderboard(spark, sf_dir):
    from fraudframe.plans.store import Store
    st = Store(spark, scratch_dir(spark, "store"))
    pid = st.save_plan(FIT_PLAN)
    tx = event_transactions(spark, sf_dir)
    for code in (1, 4, 5):      # the first job validates the plan and input that all share
        job = TrainJob(pid, model=code, selector=2, scaler=1, sampler=1)
        jid = st.save_job(job)
        st.save_estimator(jid, fit_job(tx, FIT_PLAN, job, store=st, input_id="events", validate=code == 1))
    return st.leaderboard().select("model", *[snap(c).alias(c) for c in ("MCC", "f1", "accuracy")])


# --------------------------------------------------------------------------
# D on the second transaction table: orders by customer, whole-day times
# (tied customer/date groups, single-row customers), 30-day interval
# --------------------------------------------------------------------------

from fraudframe.sources.testdata import ORDER_TRANSACTIONS_SQL, order_transactions  # noqa: E402

_ORD_SRC = f"SELECT id, card_number AS card, epoch_us(ts) AS us, amount AS v FROM ({ORDER_TRANSACTIONS_SQL}) t"


def _orders_query(profile):
    def run(spark, sf_dir):
        tx = order_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount")
        spec = LookbackSpec("card_number", "ts", "amount", (30,), profile=profile, tie="id")
        return _rounded(add_lookback_features(tx, spec), ["id"], feature_names("amount", (30,)))
    return run


register("lookback_orders_canonical", lookback_sql.canonical_sql(_ORD_SRC, "amount", (30,), DIGITS))(
    _orders_query("canonical"))
register("lookback_orders_serve", lookback_sql.serve_sql(_ORD_SRC, "amount", (30,), DIGITS))(
    _orders_query("serve"))
register("lookback_orders_train", lookback_sql.train_sql(_ORD_SRC, "amount", (30,), DIGITS))(
    _orders_query("train"))


# --------------------------------------------------------------------------
# D with a hot entity: every third event moved to one card (a third of all
# rows).  rows_per_task is set low so that this small table already takes
# the time-chunk path a 100 TB table would take; results do not depend on it.
# --------------------------------------------------------------------------

from fraudframe.operators.lookback import SkewPolicy  # noqa: E402

_HOT_SRC = ("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS card, "
            "epoch_us(ts) AS us, value AS v FROM events")


def _hot_query(profile):
    def run(spark, sf_dir):
        ev = table(spark, sf_dir, "events")
        df = ev.select(F.col("event_id").alias("id"),
                       F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"),
                       "ts", "value")
        spec = LookbackSpec("user_id", "ts", "value", (3, 7), profile=profile, tie="id")
        out = add_lookback_features(df, spec, skew=SkewPolicy(rows_per_task=1000))
        return _rounded(out, ["id"], feature_names("value", (3, 7)))
    return run


register("lookback_hot_card", lookback_sql.canonical_sql(_HOT_SRC, "value", (3, 7), DIGITS))(_hot_query("canonical"))
register("lookback_hot_card_train", lookback_sql.train_sql(_HOT_SRC, "value", (3, 7), DIGITS))(_hot_query("train"))


# --------------------------------------------------------------------------
# Build-plan slices: the count features (7-10), the gap features (11-14),
# numeric-text suitability of the text columns, and the serve profile on
# the hot card (time-chunk path).
# --------------------------------------------------------------------------

def _slice_names(intervals, lo, hi):
    names = feature_names("amount", intervals)
    return [n for i, n in enumerate(names) if lo <= i % 14 < hi]


def _slice_query(lo, hi):
    cols = _slice_names((3, 7), lo, hi)

    def run(spark, sf_dir):
        tx = event_transactions(spark, sf_dir).select("id", "card_number", "ts", "amount")
        out = add_lookback_features(tx, LookbackSpec("card_number", "ts", "amount", (3, 7)))
        return _rounded(out, ["id"], cols)
    return run


def _slice_oracle(lo, hi):
    sql = lookback_sql.canonical_sql(_LB_SRC, "amount", (3, 7), DIGITS)
    return f"SELECT id, {', '.join(_slice_names((3, 7), lo, hi))} FROM ({sql}) q"


register("daily_bucket_counts", _slice_oracle(6, 10))(_slice_query(6, 10))
register("gap_features", _slice_oracle(10, 14))(_slice_query(10, 14))


@register("numeric_string_fit", f"""
SELECT name, all_digits, fits_int FROM ({_profile_sql(EVENT_TRANSACTIONS_SQL, _TX_COLS, "id")}) p
WHERE type = 'varchar'""")
def q_numeric_string_fit(spark, sf_dir):
    p = profile_frame(event_transactions(spark, sf_dir), "id")
    return p.filter(F.col("type") == "varchar").select("name", "all_digits", "fits_int")


register("lookback_hot_card_serve", lookback_sql.serve_sql(_HOT_SRC, "value", (3, 7), DIGITS))(_hot_query("serve"))
