"""Table profiling (survey 2.B): row count, key check, binary label
candidates and numeric-text suitability from one aggregate pass, and the key
check from a second pass over the key column.

The per-column result is a DataFrame (one row per column, built by
``stack`` inside Spark); ``TableProfile`` is its small driver-side form used
by plan validation (its size is the number of columns, not rows).
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MAX = 2147483647
DIGITS = "^[0-9]+$"


def type_category(dtype: T.DataType) -> str:
    """The coarse type names plan validation speaks: int, float, varchar,
    datetime, boolean, or the Spark simple name for anything else."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "varchar"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return dtype.simpleString()


def _ones_zeros(c: Column, cat: str) -> tuple[Column, Column]:
    if cat in ("int", "float"):
        return F.count_if(c == 1), F.count_if(c == 0)
    if cat == "varchar":
        return F.count_if(c == "1"), F.count_if(c == "0")
    if cat == "boolean":
        return F.count_if(c), F.count_if(~c)
    return F.lit(0).cast("bigint"), F.lit(0).cast("bigint")


def _digit_checks(c: Column, cat: str) -> tuple[Column, Column]:
    """(all values are ASCII digit strings, none of them exceeds INT_MAX)."""
    if cat != "varchar":
        return F.lit(False), F.lit(False)
    digits = F.coalesce(c.rlike(DIGITS), F.lit(False))
    stripped = F.regexp_replace(c, "^0+(?=.)", "")
    too_big = digits & ((F.length(stripped) > 10) | ((F.length(stripped) == 10) & (stripped > F.lit(str(INT_MAX)))))
    all_digits = F.coalesce(F.bool_and(digits), F.lit(True))
    return all_digits, all_digits & (F.count_if(too_big) == 0)


def profile_frame(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """One row per column: position, name, type, n_rows, n_null, ones, zeros,
    is_label_candidate, all_digits, fits_int, applicable (extra encodings),
    is_key (``id_col`` and unique).  One scan of ``df`` without a shuffle of its
    rows; the key is tested on its own column alone."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("__n")]
    cats = []
    for i, f in enumerate(df.schema.fields):
        cat = type_category(f.dataType)
        cats.append(cat)
        c = F.col(f"`{f.name}`")
        ones, zeros = _ones_zeros(c, cat)
        dig, fits = _digit_checks(c, cat)
        aggs += [ones.alias(f"__o{i}"), zeros.alias(f"__z{i}"), F.count_if(c.isNull()).alias(f"__u{i}"),
                 dig.alias(f"__d{i}"), fits.alias(f"__f{i}")]
    one = df.agg(*aggs)
    if id_col:
        ids = df.select(F.col(f"`{id_col}`").alias("__id")).filter(F.col("__id").isNotNull())
        repeated = ids.groupBy("__id").agg(F.count(F.lit(1)).alias("__m")).filter("__m > 1").agg(
            F.count(F.lit(1)).alias("__repeated"))
        # one row with one row
        one = one.withColumn("__one", F.lit(1)).join(repeated.withColumn("__one", F.lit(1)), "__one")
    n = len(df.schema.fields)
    names = [f.name.replace("'", "''") for f in df.schema.fields]
    stack = ", ".join(
        f"{i}, '{names[i]}', '{cats[i]}', __o{i}, __z{i}, __u{i}, __d{i}, __f{i}" for i in range(n))
    repeats = "__repeated" if id_col else "CAST(NULL AS BIGINT)"
    rows = one.selectExpr(
        "__n AS n_rows", f"{repeats} AS __repeated",
        f"stack({n}, {stack}) AS (position, name, type, ones, zeros, n_null, all_digits, fits_int)")
    cand = (F.col("ones") + F.col("zeros") == F.col("n_rows")) & (F.col("ones") > 0) & (F.col("zeros") > 0)
    applicable = F.filter(F.array(F.when(F.col("all_digits"), F.lit("float")), F.when(F.col("fits_int"), F.lit("int"))),
                          lambda x: x.isNotNull())
    key = F.lit(id_col or "") == F.col("name")
    return rows.select(
        "position", "name", "type", "n_rows", "n_null", "ones", "zeros",
        cand.alias("is_label_candidate"), "all_digits", "fits_int", applicable.alias("applicable"),
        (key & (F.col("__repeated") == 0) & (F.col("n_null") == 0)).alias("is_key"),
    )


def label_candidates(profile: DataFrame) -> DataFrame:
    """(name, fraud_number, no_fraud_number) of every 0/1 column."""
    return (profile.filter("is_label_candidate")
            .select("name", F.col("ones").alias("fraud_number"), F.col("zeros").alias("no_fraud_number")))


@dataclass
class TableProfile:
    """Driver-side profile: what plan validation needs."""

    fields: list[dict]
    record_number: int
    primary_key: str = ""
    label_candidates: list[dict] = field(default_factory=list)

    def field(self, name: str) -> dict | None:
        for f in self.fields:
            if f["name"] == name:
                return f
        return None

    @property
    def names(self) -> list[str]:
        return [f["name"] for f in self.fields]


def profile_table(df: DataFrame, id_col: str | None = None) -> TableProfile:
    """Run the one-pass profile and bring its per-column rows (as many as
    the table has columns) to the driver."""
    rows = sorted(profile_frame(df, id_col).collect(), key=lambda r: r["position"])
    fields = [{"name": r["name"], "type": r["type"], "applicable": list(r["applicable"]),
               "n_null": r["n_null"]} for r in rows]
    n = rows[0]["n_rows"] if rows else 0
    key = next((r["name"] for r in rows if r["is_key"]), "")
    if id_col and not key:
        raise ValueError(f"key column {id_col!r} is NULL or not unique")
    cands = [{"name": r["name"], "fraud_number": r["ones"], "no_fraud_number": r["zeros"]}
             for r in rows if r["is_label_candidate"]]
    return TableProfile(fields, n, key, cands)
