"""Missing-value and zero-division rules as Column expressions.

Aggregates here make a group null when any of its values is null, unless ``skip_nulls`` is set.
Division follows IEEE rules (x/0 is an infinity, 0/0 is NaN) where Spark's own would raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_sum(c: Column | str, skip_nulls: bool = False) -> Column:
    c = _col(c)
    if skip_nulls:
        return F.sum(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def na_mean(c: Column | str, skip_nulls: bool = False) -> Column:
    c = _col(c)
    if skip_nulls:
        return F.avg(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def r_div(numerator: Column | str, denominator: Column | str) -> Column:
    n = _col(numerator).cast("double")
    d = _col(denominator).cast("double")
    by_zero = (
        F.when(n.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(n) | (n == 0), F.lit(float("nan")))
        .when(n > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def is_undefined(c: Column | str) -> Column:
    """True for NaN and the infinities, false for null (a missing value stays missing)."""
    c = _col(c)
    return F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(False))


def number_or_zero(c: Column | str) -> Column:
    """Text to number; the '.' sentinel, other text and nulls become 0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def clamp_at_zero(c: Column | str) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def zero_unless(value: Column | str, category: Column | str, allowed: list[str]) -> Column:
    """Keep a measure for the allowed categories and set it to 0 for all others."""
    return F.when(_col(category).isin(allowed), _col(value)).otherwise(F.lit(0.0))
