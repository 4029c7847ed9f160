from fraudframe.functions.columns import (  # noqa: F401
    array_median, epoch_micros, julian_date, safe_div,
)
