"""Wide to long and long to wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import na_sum


def to_long(df: DataFrame, ids: list[str], values: list[str] | None, variable: str, value: str) -> DataFrame:
    """Gather ``values`` (or all columns outside ``ids``) into (variable, value) rows."""
    chosen = values or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, chosen, variable, value)


def pivot_fill(
    df: DataFrame,
    by: list[str],
    column: str,
    value: str,
    values: list[str],
    fill: float | None = 0.0,
    skip_nulls: bool = False,
) -> DataFrame:
    """Spread ``column`` over the given values; combinations that do not occur take ``fill``."""
    wide = df.groupBy(*by).pivot(column, values).agg(na_sum(value, skip_nulls))
    # an absent combination is an empty group, whose count test leaves it null like a missing value
    return wide if fill is None else wide.fillna(fill, subset=[str(v) for v in values])


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Append frames by column name."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
