"""Sources and scans (survey 2.A).  Parquet is the tested path; JDBC is a
thin option over ``spark.read.format("jdbc")`` with partitioned reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_TS_FORMAT = "yyyy-MM-dd HH:mm:ss:SSSSSS"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 64, fetch_size: int = 10_000) -> DataFrame:
    """Database table as a DataFrame; give ``partition_column`` and its
    bounds so that the read is split into ``num_partitions`` range queries
    instead of one connection reading everything."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def list_schemas(spark: SparkSession) -> list[str]:
    """A1: databases of the catalog."""
    return sorted(d.name for d in spark.catalog.listDatabases())


def list_tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    """A2: distinct table names of a database."""
    return sorted({t.name for t in spark.catalog.listTables(schema)})


def field_types(df: DataFrame) -> list[tuple[str, str]]:
    """A3: column name and type in ordinal order."""
    return list(df.dtypes)


def keyed_scan(df: DataFrame, key: str) -> DataFrame:
    """A4: full scan keyed by ``key``; of the rows that repeat a key the
    smallest is kept, whatever the partitioning (columns must be orderable)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key).agg(F.min(whole).alias("__row")).select("__row.*")


def page(df: DataFrame, key: str, limit: int, offset: int = 0, ts_format: str = PAGE_TS_FORMAT, after=None) -> DataFrame:
    """A5: ``limit`` rows after ``offset`` in key order, timestamps as text.

    ``after``: the last key of the page before.  Its rows are skipped by a
    filter that reaches the scan, so a deep page costs as much as the first.
    """
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    out = rows.orderBy(key).offset(offset).limit(limit)
    ts_cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    return out.select(*[F.date_format(c, ts_format).alias(c) if c in ts_cols else F.col(c) for c in df.columns])


def newest_first(df: DataFrame, time_col: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """A6 / A7: time-descending scan (optionally without the surrogate id)."""
    return df.drop(*drop).orderBy(F.col(time_col).desc())


def lookback_scan(df: DataFrame, entity: str, entity_value, time_col: str, bound, value_col: str) -> DataFrame:
    """A8: one entity's (value, time) newer than ``bound``, newest first."""
    return (df.filter((F.col(entity) == F.lit(entity_value)) & (F.col(time_col) > F.lit(bound)))
            .select(value_col, time_col).orderBy(F.col(time_col).desc()))
