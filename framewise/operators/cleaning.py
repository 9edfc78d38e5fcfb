"""Filling, capping and reporting; every statistic is a one-row table joined to the data."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import (
    field_type,
    is_integer,
    is_numeric,
    ref,
    require_columns,
    require_numeric,
)
from framewise.functions.quantiles import group_percentiles

FILL_STRATEGIES = ("mean", "median", "mode", "zero", "value")


def _mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest of them on ties; 0 for a column without values."""
    counts = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    top = counts.orderBy(F.desc("_n"), "_s").limit(1)
    return top.agg(F.coalesce(F.max("_s"), F.lit(0).cast(field_type(df, column))).alias("_s"))


def fill_missing(
    df: DataFrame, column: str, strategy: str, value: Any = None
) -> DataFrame:
    """Replace missing values by the mean, median, mode, zero or a given value.

    A whole-number column filled with a fractional statistic becomes floating point.
    """
    require_columns(df, column)
    dtype = field_type(df, column)
    if strategy in ("mean", "median"):
        if not is_numeric(dtype):
            raise ValueError(f"Strategy '{strategy}' requires a numeric column; '{column}' is not")
        if strategy == "mean":
            stat = df.agg(F.avg(ref(column)).alias("_s"))
        else:
            stat = group_percentiles(df, [], column, {"_s": 0.5})
    elif strategy == "mode":
        stat = _mode(df, column)
    elif strategy in ("zero", "value"):
        if strategy == "value" and value is None:
            raise ValueError("A fill value must be provided when strategy='value'")
        fill = F.lit(0 if strategy == "zero" else value)
        if not is_integer(dtype) or isinstance(value, int) or strategy == "zero":
            fill = fill.cast(dtype)
        return df.withColumn(column, F.coalesce(ref(column), fill))
    else:
        raise ValueError(f"Unknown strategy '{strategy}'. Use: {', '.join(FILL_STRATEGIES)}")
    filled = df.crossJoin(F.broadcast(stat))
    return filled.withColumn(column, F.coalesce(ref(column), F.col("_s"))).drop("_s")


def cap_bounds(df: DataFrame, column: str, percentile: float = 99.0) -> DataFrame:
    """One row: lower and upper bound at the (100 - p)th and pth percentile, p held in 50-99.9."""
    require_numeric(df, column)
    p = max(50.0, min(99.9, float(percentile)))
    return group_percentiles(
        df, [], column, {"lower_bound": (100.0 - p) / 100.0, "upper_bound": p / 100.0}
    )


def cap_outliers(df: DataFrame, column: str, percentile: float = 99.0) -> DataFrame:
    """Clip a numeric column to its percentile bounds; missing values stay missing."""
    bounds = cap_bounds(df, column, percentile)
    low, high = F.col("lower_bound"), F.col("upper_bound")
    clipped = F.when(
        ref(column).isNotNull(), F.least(F.greatest(ref(column).cast("double"), low), high)
    )
    capped = df.crossJoin(F.broadcast(bounds)).withColumn(column, clipped)
    return capped.drop("lower_bound", "upper_bound")


def cap_report(df: DataFrame, column: str, percentile: float = 99.0) -> DataFrame:
    """One row: the bounds and how many values they change."""
    bounds = cap_bounds(df, column, percentile)
    low, high = F.col("lower_bound"), F.col("upper_bound")
    outside = (ref(column) < low) | (ref(column) > high)
    return (
        df.crossJoin(F.broadcast(bounds))
        .groupBy("lower_bound", "upper_bound")
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(outside).alias("modified_count"))
        .select(
            F.round("lower_bound", 4).alias("lower_bound"),
            F.round("upper_bound", 4).alias("upper_bound"),
            "row_count",
            "modified_count",
        )
    )


def fill_report(before: DataFrame, column: str, strategy: str, value: Any = None) -> DataFrame:
    """One row: rows and how many missing values a fill replaces."""
    after = fill_missing(before, column, strategy, value)
    gaps = before.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(ref(column).isNull()).alias("_b"))
    left = after.agg(F.count_if(ref(column).isNull()).alias("_a"))
    return gaps.crossJoin(left).select(
        F.lit(column).alias("column"),
        F.lit(strategy).alias("strategy"),
        "row_count",
        (F.col("_b") - F.col("_a")).alias("modified_count"),
    )


def cleaning_report(before: DataFrame, after: DataFrame, operation: str) -> DataFrame:
    """One row: rows before and after and the rows removed."""
    b = before.agg(F.count(F.lit(1)).alias("before_rows"))
    a = after.agg(F.count(F.lit(1)).alias("after_rows"))
    return b.crossJoin(a).select(
        F.lit(operation).alias("operation"),
        "before_rows",
        "after_rows",
        (F.col("before_rows") - F.col("after_rows")).alias("modified_count"),
        F.lit(len(before.columns)).alias("before_columns"),
        F.lit(len(after.columns)).alias("after_columns"),
    )


def changed_rows(before: DataFrame, after: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """One row: how many keyed rows hold another value in a column afterwards."""
    b = before.select(*[ref(k) for k in key], ref(column).alias("_b"))
    a = after.select(*[ref(k) for k in key], ref(column).alias("_a"))
    changed = ~F.col("_b").eqNullSafe(F.col("_a"))
    return b.join(a, list(key)).agg(F.count_if(changed).alias("modified_count"))
