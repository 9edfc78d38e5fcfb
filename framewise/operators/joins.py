"""Equi-joins with clash handling, join-key discovery and feedback pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import ref, require_columns
from framewise.functions.scale import is_small
from framewise.operators.profile import distinct_counts

HOW = ("inner", "left", "right", "outer")


def conflict_columns(left: DataFrame, right: DataFrame, key: str) -> list[str]:
    """Names, other than the key, found on both sides."""
    return sorted((set(left.columns) & set(right.columns)) - {key})


def merge(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"),
    null_safe: bool = True,
) -> DataFrame:
    """Join on one shared column; clashing columns get a suffix on both sides, the key stays one column.

    Missing keys match each other unless ``null_safe`` is off. No hint is given: Spark broadcasts a side it
    knows to be small and otherwise sort-merges, where its adaptive skew handling splits hot keys. That
    handling does not cover full outer joins, so a large one runs as a left join plus the right rows that
    found no partner.
    """
    for side, name in ((left, "left"), (right, "right")):
        if key not in side.columns:
            raise ValueError(f"Join key '{key}' not found in {name} dataset")
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}, got '{how}'")
    clash = set(conflict_columns(left, right, key))

    def named(column: str, suffix: str) -> str:
        return column + suffix if column in clash else column

    left_names = [named(c, suffixes[0]) for c in left.columns if c != key]
    right_names = [named(c, suffixes[1]) for c in right.columns if c != key]
    a = left.select(
        ref(key).alias("_lk"), *[ref(c).alias(named(c, suffixes[0])) for c in left.columns if c != key]
    )
    b = right.select(
        ref(key).alias("_rk"),
        *[ref(c).alias(named(c, suffixes[1])) for c in right.columns if c != key],
    )

    def match(x: str, y: str):
        return F.col(x).eqNullSafe(F.col(y)) if null_safe else F.col(x) == F.col(y)

    columns = [*left_names, *right_names]
    if how == "outer" and not (is_small(a) and is_small(b)):
        matched = a.join(b, match("_lk", "_rk"), "left").select(
            F.col("_lk").alias(key), *[ref(c) for c in columns]
        )
        seen = a.select(F.col("_lk").alias("_seen")).distinct()
        rest = b.join(seen, match("_rk", "_seen"), "left_anti").select(
            F.col("_rk").alias(key), *[ref(c) for c in right_names]
        )
        joined = matched.unionByName(rest, allowMissingColumns=True)
    else:
        joined = a.join(b, match("_lk", "_rk"), "full" if how == "outer" else how)
        picked = {"left": F.col("_lk"), "inner": F.col("_lk"), "right": F.col("_rk")}.get(
            how, F.coalesce("_lk", "_rk")
        )
        joined = joined.select(picked.alias(key), *[ref(c) for c in columns])
    order = [key if c == key else named(c, suffixes[0]) for c in left.columns]
    return joined.select(*[ref(c) for c in [*order, *right_names]])


def suggest_join_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared columns with their types, distinct counts and uniqueness, most unique first."""
    common = sorted(set(left.columns) & set(right.columns))
    if not common:
        raise ValueError("The tables share no column")

    def side(df: DataFrame, tag: str) -> DataFrame:
        kinds = F.create_map(
            *[x for c in common for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))]
        )
        stats = distinct_counts(df, common)
        ratio = F.col("distinct_count") / F.greatest(F.col("row_count"), F.lit(1))
        return stats.select(
            F.col("column").alias("name"),
            kinds[F.col("column")].alias(f"dtype_{tag}"),
            F.col("distinct_count").alias(f"unique_{tag}"),
            ratio.alias(f"_u_{tag}"),
        )

    # One row per shared column on both sides.
    both = side(left, "left").join(side(right, "right"), "name")
    ul, ur = F.col("_u_left"), F.col("_u_right")
    return both.select(
        "name",
        "dtype_left",
        "dtype_right",
        "unique_left",
        "unique_right",
        F.round(ul, 3).alias("uniqueness_left"),
        F.round(ur, 3).alias("uniqueness_right"),
        ((ul > 0.5) | (ur > 0.5)).alias("recommended"),
    ).orderBy(F.desc(F.col("uniqueness_left") + F.col("uniqueness_right")), "name")


def pair_feedback(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Feedback rows with an outcome joined to the numeric prediction they speak about."""
    require_columns(feedback, "deployment_id", "prediction_log_id", "actual_value")
    require_columns(log, "id", "prediction_numeric")
    outcomes = feedback.where(
        F.col("actual_value").isNotNull() & F.col("prediction_log_id").isNotNull()
    )
    predictions = log.where(F.col("prediction_numeric").isNotNull()).select(
        F.col("id").alias("prediction_log_id"), F.col("prediction_numeric")
    )
    return outcomes.join(predictions, "prediction_log_id")


def merge_and_profile(
    left: DataFrame, right: DataFrame, key: str, how: str, path: str
) -> tuple[DataFrame, DataFrame]:
    """Join, save the result as Parquet, and profile the saved copy."""
    from framewise.operators.profile import column_stats

    merge(left, right, key, how).write.mode("errorifexists").parquet(path)
    saved = left.sparkSession.read.parquet(path)
    return saved, column_stats(saved)
