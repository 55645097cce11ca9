"""Per-group statistics that stay exact and distributed: peaks, medians, quantiles, fits, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_undefined, na_mean, na_sum
from .matching import match
from .ordered import rows_below

FIVE = {"minimum": 0.0, "lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75, "maximum": 1.0}


def group_sum(df: DataFrame, by: list[str], measures: list[str] | dict[str, str], skip_nulls: bool = False) -> DataFrame:
    names = {m: m for m in measures} if isinstance(measures, list) else measures
    return df.groupBy(*by).agg(*[na_sum(m, skip_nulls).alias(n) for m, n in names.items()])


def group_mean(df: DataFrame, by: list[str], measures: list[str] | dict[str, str], skip_nulls: bool = False) -> DataFrame:
    names = {m: m for m in measures} if isinstance(measures, list) else measures
    return df.groupBy(*by).agg(*[na_mean(m, skip_nulls).alias(n) for m, n in names.items()])


def mixed_rollup(
    df: DataFrame, by: list[str], means: dict[str, str], sums: dict[str, str], skip_nulls: bool = False
) -> DataFrame:
    """Means of some measures and sums of others in one pass."""
    return df.groupBy(*by).agg(
        *[na_mean(m, skip_nulls).alias(n) for m, n in means.items()],
        *[na_sum(m, skip_nulls).alias(n) for m, n in sums.items()],
    )


def first_peak(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Order value of the largest ``value`` per group, the earliest one on ties; missing values are skipped.

    An aggregate, so every task reduces its rows before the shuffle.
    """
    v = F.col(value)
    best = F.min(F.struct((-v).alias("key"), F.col(order).alias("at")))
    present = df.where(v.isNotNull() & ~is_undefined(v))
    return present.groupBy(*by).agg(best.alias("_best")).select(
        *by, F.col("_best.at").alias(order), (-F.col("_best.key")).alias(value)
    )


def nearest_to_median(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Row whose value is nearest to the group's median, the first one on ties; missing values are skipped.

    Nearest are the middle value of an odd number of rows, and both middle values of an even number, which lie equally
    far from their mean: values are compared, no distance is taken, so there is nothing to round. Groups are short (the
    days of a month).
    """
    v = F.col(value)
    whole, sorted_ = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value)
    ranked = df.where(v.isNotNull()).withColumns({"_rank": F.row_number().over(sorted_), "_n": F.count(F.lit(1)).over(whole)})
    middle = (2 * F.col("_rank")).between(F.col("_n"), F.col("_n") + 2)
    low, high = F.min(F.when(middle, v)).over(whole), F.max(F.when(middle, v)).over(whole)
    near = ranked.withColumns({"_low": low, "_high": high}).where((v == F.col("_low")) | (v == F.col("_high")))
    return near.groupBy(*by).agg(F.min(order).alias(order))


def five_number(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact minimum, quartiles and maximum (linear interpolation) of each group.

    Equal values of a group are counted first, so that a value with most of the rows is one row; ranks come from
    histograms of the distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_count"))
    ranked = rows_below(counts, value, by, "_count").withColumn("_rank", F.col("_before") + F.col("_count"))
    before = F.col("_before")
    span = F.col("_size") - 1
    picks, needed = [], F.lit(False)
    for name, p in FIVE.items():
        low = F.floor(span * p) + 1
        high = F.ceil(span * p) + 1
        at_low, at_high = ((before < at) & (at <= F.col("_rank")) for at in (low, high))
        needed = needed | at_low | at_high
        picks.append((name, p, at_low, at_high))
    few = ranked.where(needed)
    bounds = few.groupBy(*by, "_size").agg(
        *[F.max(F.when(lo, F.col(value))).alias(f"_{n}_lo") for n, _, lo, _ in picks],
        *[F.max(F.when(hi, F.col(value))).alias(f"_{n}_hi") for n, _, _, hi in picks],
    )
    values = []
    for name, p, _, _ in picks:
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        part = span * p - F.floor(span * p)
        values.append((lo + (hi - lo) * part).alias(name))
    return bounds.select(*by, F.col("_size").alias("n"), *values)


def fit_columns(y: str, x: str, prefix: str = "") -> list[Column]:
    """R2, slope and intercept of the least-squares line of y on x, as aggregates."""
    return [
        F.regr_r2(y, x).alias(f"{prefix}r2"),
        F.regr_slope(y, x).alias(f"{prefix}slope"),
        F.regr_intercept(y, x).alias(f"{prefix}intercept"),
    ]


def group_fit(df: DataFrame, y: str, x: str, by: list[str], prefix: str = "") -> DataFrame:
    return df.groupBy(*by).agg(*fit_columns(y, x, prefix))


def category_rank(df: DataFrame, category: str, value: str, name: str = "category_rank") -> DataFrame:
    """Order of the categories by their largest ``value``, lowest first, ties by name.

    The window runs over one row per category, after the aggregation.
    """
    tops = df.groupBy(category).agg(F.max(value).alias(value))
    return tops.withColumn(name, F.row_number().over(Window.orderBy(F.col(value), F.col(category))))


def with_category_rank(df: DataFrame, ranks: DataFrame, category: str, name: str = "category_rank") -> DataFrame:
    return match(df, ranks.select(category, name), [category])


def rank_by_total(df: DataFrame, category: str, total: str, name: str) -> DataFrame:
    """Order of the categories of a report table whose rows carry their category's total.

    The window runs over the report (one row per scenario and category), not over its inputs.
    """
    return df.withColumn(name, F.dense_rank().over(Window.orderBy(F.col(total), F.col(category))))


def distinct_counts(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(n) for c, n in columns.items()]
    )
