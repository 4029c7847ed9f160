"""Column encoding (survey 2.C): every kept column becomes a double.

* numeric columns without a parameter and the label: ``cast("double")``
* ``julian``: astronomical Julian date of the timestamp
* ``label_encoder``: code 0..n-1 of the value among the sorted distinct
  values; the dictionary is a DataFrame built with a distributed sort, and
  joined back (broadcast only when its checked size allows)
* ``float`` / ``int``: parse digit text; text that does not parse fails the job
* ``omit`` and the key: dropped

Output columns: the key (raw), ``_entity`` (raw entity value, the partition
key of later look-back features: an encoded 16-digit card number is not
exact as a double), ``_us`` (BIGINT epoch microseconds of the time base),
the encoded columns in table order, the label last.
"""
from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudframe.functions.columns import epoch_micros, julian_date
from fraudframe.functions.ranking import index_sorted
from fraudframe.operators.profile import TableProfile, type_category
from fraudframe.plans.spec import FLOAT, FRAUD_TYPE, INT, JULIAN, LABEL_ENCODER, OMIT, EncodingPlan, content_id

ENTITY = "_entity"
US = "_us"
# dictionaries with at most this many entries are broadcast to the join
BROADCAST_DICT_ROWS = 2_000_000


def encoded_field_names(columns: list[str], encoding: dict[str, str], key: str | None) -> list[str]:
    """Table order, minus the key and omitted columns, the label moved last."""
    out, label = [], None
    for c in columns:
        if c == key:
            continue
        e = encoding.get(c)
        if e == FRAUD_TYPE:
            label = c
        elif e != OMIT:
            out.append(c)
    return out + ([label] if label else [])


def dense_index(values: DataFrame, col: str, code: str = "code") -> DataFrame:
    """Distinct values of ``col`` with codes 0..n-1 in ascending order
    (distributed: see ``functions.ranking.index_sorted``)."""
    distinct = values.select(col).distinct().filter(F.col(col).isNotNull())
    return index_sorted(distinct, [col], code)


@dataclass
class EncoderModel:
    """A fitted encoding: plan, source column order and dictionaries."""

    plan: EncodingPlan
    columns: list[str]
    types: dict[str, str]
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    _content_id: str | None = field(default=None, repr=False, compare=False)

    @property
    def output_names(self) -> list[str]:
        return encoded_field_names(self.columns, self.plan.encoding, self.plan.key)

    @property
    def label(self) -> str | None:
        return self.plan.label

    def _dict_join(self, df: DataFrame, c: str, handle_unseen: str) -> DataFrame:
        d = self.dictionaries[c].select(F.col(c).alias(f"__dv_{c}"), F.col("code").alias(f"__dc_{c}"))
        n = d.count()
        d = F.broadcast(d) if n <= BROADCAST_DICT_ROWS else d
        out = df.join(d, F.col(f"`{c}`") == F.col(f"__dv_{c}"), "left")
        code = F.col(f"__dc_{c}").cast("double")
        if handle_unseen == "error":
            code = F.when(code.isNull() & F.col(f"`{c}`").isNotNull(),
                          F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col(f"`{c}`").cast("string")))
                          .cast("double")).otherwise(code)
        elif handle_unseen == "keep":
            code = F.when(code.isNull() & F.col(f"`{c}`").isNotNull(), F.lit(float(n))).otherwise(code)
        return out.withColumn(f"__enc_{c}", code).drop(f"__dv_{c}", f"__dc_{c}")

    def transform(self, df: DataFrame, handle_unseen: str = "error", require_label: bool = True) -> DataFrame:
        plan = self.plan
        enc = plan.encoding
        names = [n for n in self.output_names if require_label or n != self.label]
        for c in names:
            if enc.get(c) == LABEL_ENCODER:
                df = self._dict_join(df, c, handle_unseen)
        tdt = df.schema[plan.time_base].dataType
        out: list[Column] = []
        if plan.key and plan.key in df.columns:
            out.append(F.col(plan.key))
        out.append(F.col(plan.entity).alias(ENTITY))
        out.append(epoch_micros(plan.time_base, tdt).alias(US))
        for c in names:
            out.append(self._encode_col(df, c).alias(c))
        return df.select(*out)

    def _encode_col(self, df: DataFrame, c: str) -> Column:
        e = self.plan.encoding.get(c)
        col = F.col(f"`{c}`")
        if e == LABEL_ENCODER:
            return F.col(f"__enc_{c}")
        if e == JULIAN:
            return julian_date(epoch_micros(col, df.schema[c].dataType))
        if e in (FLOAT, INT):
            parsed = col.try_cast("double" if e == FLOAT else "bigint")
            bad = parsed.isNull() & col.isNotNull()
            return F.when(bad, F.raise_error(F.concat(F.lit(f"cannot convert {c} to {e}: "), col.cast("string")))
                          .cast("double")).otherwise(parsed.cast("double"))
        return col.cast("double")

    def content_id(self) -> str:
        """Equal for encoders that encode alike, whichever objects or folders hold them: the encoding
        part of the plan, the columns and the dictionaries' entries (their number and the sum of
        their hashes, one aggregate a dictionary, kept after the first call)."""
        if self._content_id is None:
            entry = F.xxhash64
            found = {c: list(map(str, d.agg(F.count(F.lit(1)), F.sum(entry(F.col(c), F.col("code").cast("long")).cast("decimal(38,0)"))).first()))
                     for c, d in sorted(self.dictionaries.items())}
            self._content_id = content_id("encoder", self.plan.encoding_json(), self.columns, self.types, found)
        return self._content_id

    # persistence: one parquet table per dictionary, then the plan JSON
    def save(self, path: str) -> None:
        import json
        spark = SparkSession.getActiveSession()
        for c, d in self.dictionaries.items():
            d.write.mode("overwrite").parquet(os.path.join(path, "dict", c))
        meta = {"plan": json.loads(self.plan.to_json()), "columns": self.columns, "types": self.types,
                "dictionaries": sorted(self.dictionaries)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "meta"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EncoderModel":
        import json
        from fraudframe.plans.spec import FeatureParams
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        p = meta["plan"]
        plan = EncodingPlan(p["table"], p["time_base"], p["encoding"], FeatureParams.from_dict(p["features"]),
                            p["entity"], p["key"], p.get("profile", "canonical"))
        dicts = {c: spark.read.parquet(os.path.join(path, "dict", c)) for c in meta["dictionaries"]}
        return EncoderModel(plan, meta["columns"], meta["types"], dicts)


def fit_encoder(df: DataFrame, plan: EncodingPlan) -> EncoderModel:
    from fraudframe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    types = {f.name: type_category(f.dataType) for f in df.schema.fields}
    # a dictionary is a fitted artifact: computed once (one distinct over the
    # table), stored in the checkpoint folder, then counted and joined cheaply
    dicts = {c: dense_index(df, c).checkpoint() for c, e in plan.encoding.items() if e == LABEL_ENCODER}
    return EncoderModel(plan, list(df.columns), types, dicts)


def encode(df: DataFrame, plan: EncodingPlan) -> tuple[DataFrame, EncoderModel]:
    model = fit_encoder(df, plan)
    return model.transform(df), model


def split_bad_rows(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """New-record contract (C12): every column of ``contract`` (name -> one of
    int, float, varchar, datetime) must be present and parse.  Adds
    ``reject_reason`` (NULL for a good row) naming the first failing field."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"required fields missing: {missing}")
    target = {"int": "bigint", "float": "double", "varchar": "string", "datetime": "timestamp"}
    reasons = []
    for c, t in contract.items():
        col = F.col(f"`{c}`")
        ok = col.cast("string").try_cast(target[t]).isNotNull()
        reasons.append(F.when(col.isNull(), F.lit(f"{c}: missing")).when(~ok, F.lit(f"{c}: not {t}")))
    return df.withColumn("reject_reason", F.coalesce(*reasons))
