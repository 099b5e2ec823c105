"""Arithmetic that gives null or a default where ANSI SQL would raise."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b, default=0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def pearson(a, b) -> Column:
    """Aggregate: correlation, 0 where a variance is 0 or there are no rows."""
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def clip(x, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def null_nan(x) -> Column:
    """NaN and null are one missing marker."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def distinct_sketch(x) -> Column:
    """Aggregate: about how many distinct values; one small binary buffer, so a table may have many such columns."""
    x = F.col(x) if isinstance(x, str) else x
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(13)))
