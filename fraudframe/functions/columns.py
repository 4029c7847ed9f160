"""Column-expression helpers.  Everything here is a built-in Spark
expression, so it stays inside whole-stage codegen."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegerType, LongType, TimestampType

MICROS_PER_DAY = 86_400_000_000
# Julian day number of 1970-01-01 00:00:00 (fixed astronomical constant).
UNIX_EPOCH_JULIAN = 2440587.5


def epoch_micros(col: Column | str, dtype: DataType | None = None) -> Column:
    """Whole microseconds since 1970-01-01 as BIGINT.

    TIMESTAMP values are instants (``unix_micros``).  TIMESTAMP_NTZ and DATE
    values are wall-clock values: they are measured field by field, so the
    result never depends on the session time zone (no DST shifts).
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (LongType, IntegerType)):
        return c.cast("bigint")  # already epoch microseconds
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, DateType):
        return F.unix_date(c).cast("bigint") * F.lit(MICROS_PER_DAY)
    day = F.unix_date(F.to_date(c)).cast("bigint")
    secs = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * F.lit(1_000_000)
    frac = (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return day * F.lit(MICROS_PER_DAY) + secs + frac


def julian_date(us: Column) -> Column:
    """Astronomical Julian date (float days) of epoch microseconds."""
    return us.cast("double") / F.lit(float(MICROS_PER_DAY)) + F.lit(UNIX_EPOCH_JULIAN)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (or either side is NULL)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def array_median(arr: Column, empty: float = 0.0, is_sorted: bool = False) -> Column:
    """Midpoint median of a numeric array, ``empty`` if it has no element.

    Uses the native ``sort_array`` (codegen) rather than the lambda-based
    ``array_sort``; pass ``is_sorted`` for an array already in order.
    """
    s = arr if is_sorted else F.sort_array(arr)
    n = F.size(s)
    lo = F.try_element_at(s, F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1)))
    hi = F.try_element_at(s, F.greatest(F.floor(n / 2).cast("int") + 1, F.lit(1)))
    return F.when(n > 0, (lo.cast("double") + hi.cast("double")) / 2).otherwise(F.lit(empty))
