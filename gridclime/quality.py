"""Data-quality operators.

Most return the offending or the counted rows as a DataFrame. Metrics are counted while a table is written: they cost
no scan of their own, and ``require`` compares them with the values that a job expects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .operators.matching import match


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once; empty for a valid primary key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def group_counts(df: DataFrame, by: list[str], expected: int | None = None) -> DataFrame:
    """Row count per group; with ``expected``, only the groups that differ from it."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts if expected is None else counts.where(F.col("n_rows") != expected)


def negative_demand(df: DataFrame, value: str = "final_demand_mw") -> DataFrame:
    return df.where(F.col(value) < 0)


def negative_demand_days(df: DataFrame, value: str = "final_demand_mw", ts: str = "timestamp_utc") -> DataFrame:
    return negative_demand(df, value).select(F.col(ts).cast("date").alias("date")).distinct()


def unmapped(df: DataFrame, mapping: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    """Rows without a partner in the mapping."""
    return match(df, mapping, keys, "left_anti")


def above(df: DataFrame, value: str, limit: float = 1.0) -> DataFrame:
    """Rows above a limit, such as capacity factors greater than one."""
    return df.where(F.col(value) > limit)


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def dropped_for_nulls(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows before and after the completeness filter, in one pass."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    kept = F.count(F.when(complete, 1))
    n = F.count(F.lit(1))
    return df.groupBy(*(by or [])).agg(n.alias("rows_before"), kept.alias("rows_after"), (n - kept).alias("rows_dropped"))


def weight_identity(timeseries: DataFrame, period_years: int, by: list[str], hours_per_day: int = 24) -> DataFrame:
    """Hours per year that the weights of a sample add up to, per period."""
    total = F.sum("scaling_to_period") * hours_per_day / F.lit(period_years)
    return timeseries.groupBy(*by).agg(total.alias("hours_in_year"))


class CheckFailed(ValueError):
    """A table's metrics are not what the job expects."""


def mark_repeats(df: DataFrame, keys: list[str], name: str = "_repeat") -> DataFrame:
    """True for all rows of a key combination but one; count them in the metrics instead of grouping the table again."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1)


def mark_group_size(df: DataFrame, by: list[str], name: str = "_group_size") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by)))


def n_where(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def observed(df: DataFrame, metrics: dict[str, Column], without: list[str] | None = None) -> tuple[DataFrame, Observation]:
    """The rows, and what they will have been once an action has run over them: aggregates by name.

    Columns ``without`` (marks) serve the metrics only and are dropped.
    """
    seen = Observation()
    watched = df.observe(seen, *[c.alias(name) for name, c in metrics.items()])
    return watched.drop(*(without or [])), seen


def require(found: dict[str, object], expected: dict[str, object]) -> None:
    """Raise CheckFailed where a metric differs from its expected value."""
    wrong = [f"{name} is {found.get(name)}, not {value}" for name, value in expected.items() if found.get(name) != value]
    if wrong:
        raise CheckFailed("; ".join(wrong))
