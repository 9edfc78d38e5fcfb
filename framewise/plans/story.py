"""The combined data report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import numeric_columns, text_columns
from framewise.operators.aggregates import group_stats, target_correlations
from framewise.operators.mining import anomaly_scores
from framewise.operators.profile import column_stats
from framewise.operators.quality import readiness, readiness_components


def best_category(df: DataFrame) -> str | None:
    """Text column with 2-20 distinct values, closest to min(10, rows // 10); the first one on ties."""
    texts = text_columns(df)
    if not texts:
        return None
    # One row per text column.
    stats = column_stats(df.select(*texts), samples=False).orderBy("ordinal").collect()
    fits = [r for r in stats if 2 <= r["unique_count"] <= 20]
    if not fits:
        return None
    return min(fits, key=lambda r: abs(r["unique_count"] - min(10, r["row_count"] // 10)))["column"]


def data_story(
    df: DataFrame, key: list[str], target: str | None = None, with_anomalies: bool = True
) -> DataFrame:
    """Readiness, breakdown by the best category, drivers of the target and anomaly count in long form."""
    numeric = numeric_columns(df)

    def section(rows: DataFrame, name: str, item: Column, number: Column, text: Column) -> DataFrame:
        return rows.select(
            F.lit(name).alias("section"),
            item.cast("string").alias("item"),
            F.round(number.cast("double"), 4).alias("number"),
            text.cast("string").alias("text"),
        )

    parts = [
        section(readiness(df, target), "readiness", F.lit("total"), F.col("score"), F.col("grade")),
        section(
            readiness_components(df, target),
            "readiness",
            F.col("component"),
            F.col("score"),
            F.col("status"),
        ),
    ]
    category = best_category(df)
    if category and numeric:
        groups = group_stats(df, category, [numeric[0]])
        parts.append(
            section(groups, "breakdown", F.col(category), F.col(numeric[0]), F.lit(category))
        )
    if target in numeric and len(numeric) > 1:
        drivers = target_correlations(df, target, 5)
        parts.append(
            section(drivers, "drivers", F.col("column"), F.col("correlation"), F.col("strength"))
        )
    if with_anomalies and numeric:
        scored = anomaly_scores(df, numeric[:8], key)
        found = scored.agg(F.count_if("is_anomaly").alias("n"), F.count(F.lit(1)).alias("rows"))
        found = found.where(F.col("rows") >= 10)
        parts.append(section(found, "anomalies", F.lit("count"), F.col("n"), F.lit(None)))
    return reduce(DataFrame.unionByName, parts)


def next_step(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: fix_data, set_target or train_model."""
    ready = readiness(df, target)
    step = F.when(F.col("status") == "not_ready", "fix_data").when(
        F.lit(target is None), "set_target"
    ).otherwise("train_model")
    return ready.select(step.alias("next_step"), "score", "grade")
