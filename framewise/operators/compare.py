"""Comparing two segments or two time windows on every numeric column."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import (
    field_type,
    numeric_columns,
    parse_timestamp,
    ref,
    require_columns,
)
from framewise.functions.quantiles import group_percentiles
from framewise.operators.aggregates import unpivot_numeric


def compare_segments(df: DataFrame, group_col: str, first: str, second: str) -> DataFrame:
    """Per numeric column: mean, std, median and count in both segments and the standardised difference.

    Segment names match trimmed and without regard to case. Only rows of the two segments are shuffled, as
    partial sums.
    """
    require_columns(df, group_col)
    names = numeric_columns(df, exclude=[group_col])
    if not names:
        raise ValueError("No numeric columns to compare")
    label = F.lower(F.trim(ref(group_col).cast("string")))
    a, b = first.strip().lower(), second.strip().lower()
    side = F.when(label == a, 1).when(label == b, 2)
    rows = df.where(label.isin(a, b))
    long = unpivot_numeric(rows, names, keep=[side.alias("side")])
    long = long.where(F.col("value").isNotNull())
    stats = long.groupBy("column", "side").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count("value").alias("n"),
    )
    medians = group_percentiles(long, ["column", "side"], "value", {"median": 0.5})
    # Two rows per numeric column.
    stats = stats.join(F.broadcast(medians), ["column", "side"])

    def pick(value: str, which: int, name: str):
        return F.max(F.when(F.col("side") == which, F.col(value))).alias(name)

    wide = stats.groupBy("column").agg(
        *[
            pick(value, which, f"{value}{which}")
            for which in (1, 2)
            for value in ("mean", "std", "median", "n")
        ]
    )
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    pooled = F.sqrt(
        ((n1 - 1) * F.pow("std1", F.lit(2)) + (n2 - 1) * F.pow("std2", F.lit(2))) / F.nullif(n1 + n2 - 2, F.lit(0))
    )
    diff = F.col("mean1") - F.col("mean2")
    effect = F.when(pooled > 0, diff / pooled).when(F.col("mean2") != 0, diff / F.abs("mean2"))
    shaped = wide.select(
        "column",
        *[F.col(f"{v}{i}").alias(f"{v}{i}") for i in (1, 2) for v in ("mean", "std", "median")],
        n1.alias("count1"),
        n2.alias("count2"),
        F.round(effect, 3).alias("effect_size"),
    )
    direction = F.when(F.col("effect_size") > 0, "higher_in_val1").when(
        F.col("effect_size").isNotNull(), "higher_in_val2"
    )
    return shaped.withColumn("direction", direction)


def notable_diffs(df: DataFrame, group_col: str, first: str, second: str) -> DataFrame:
    """Columns whose standardised difference is above one half, largest first."""
    rows = compare_segments(df, group_col, first, second)
    return rows.where(F.abs("effect_size") > 0.5).select("column", "effect_size", "direction").orderBy(
        F.desc(F.abs("effect_size")), "column"
    )


def period_bounds(df: DataFrame, date_col: str, preset: str) -> DataFrame:
    """One row with two named, inclusive day ranges.

    Presets: ``2023 vs 2024``, ``Q1 vs Q2`` (year of the latest date unless given as ``Q1 2023 vs Q2 2024``),
    ``H1 vs H2``, ``yoy``, ``mom``, and ``halves``, which splits the date range in the middle.
    """
    require_columns(df, date_col)
    t = parse_timestamp(ref(date_col), field_type(df, date_col))
    ends = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    latest = F.year("hi")
    text = preset.strip().lower()

    def days(y, first: str, last: str):
        return (
            F.concat(y.cast("string"), F.lit(f"-{first}")),
            F.concat(y.cast("string"), F.lit(f"-{last}")),
        )

    quarters = {
        1: ("01-01", "03-31"),
        2: ("04-01", "06-30"),
        3: ("07-01", "09-30"),
        4: ("10-01", "12-31"),
    }
    years = re.fullmatch(r"(\d{4})\s*(?:vs\.?|and|to)\s*(\d{4})", text)
    parts = re.fullmatch(r"q([1-4])(?:\s+(\d{4}))?\s*(?:vs\.?|and|to)\s*q([1-4])(?:\s+(\d{4}))?", text)
    if years and years.group(1) != years.group(2):
        y1, y2 = (F.lit(int(y)) for y in years.groups())
        names = y1.cast("string"), y2.cast("string")
        spans = days(y1, "01-01", "12-31"), days(y2, "01-01", "12-31")
    elif parts:
        q1, y1, q2, y2 = parts.groups()
        c1 = F.lit(int(y1)) if y1 else latest
        c2 = F.lit(int(y2)) if y2 else latest
        names = (
            F.concat(F.lit(f"Q{q1} "), c1.cast("string")),
            F.concat(F.lit(f"Q{q2} "), c2.cast("string")),
        )
        spans = days(c1, *quarters[int(q1)]), days(c2, *quarters[int(q2)])
    elif text in ("h1 vs h2", "first half vs second half"):
        names = (
            F.concat(F.lit("H1 "), latest.cast("string")),
            F.concat(F.lit("H2 "), latest.cast("string")),
        )
        spans = days(latest, "01-01", "06-30"), days(latest, "07-01", "12-31")
    elif text == "yoy":
        names = (latest - 1).cast("string"), latest.cast("string")
        spans = days(latest - 1, "01-01", "12-31"), days(latest, "01-01", "12-31")
    elif text == "mom":
        month = F.trunc("hi", "month")
        before = F.add_months(month, -1)
        names = F.date_format(before, "MMM yyyy"), F.date_format(month, "MMM yyyy")
        spans = tuple(
            (F.date_format(m, "yyyy-MM-dd"), F.date_format(F.last_day(m), "yyyy-MM-dd"))
            for m in (before, month)
        )
    elif text == "halves":
        lo, hi = F.unix_micros(F.col("lo").cast("timestamp")), F.unix_micros(F.col("hi").cast("timestamp"))
        mid = F.timestamp_micros(lo + F.floor((hi - lo) / 2))

        def month_name(c):
            return F.date_format(c, "MMM yyyy")

        names = (
            F.concat_ws(" – ", month_name(F.col("lo")), month_name(mid)),
            F.concat_ws(" – ", month_name(mid), month_name(F.col("hi"))),
        )
        spans = (
            (F.date_format("lo", "yyyy-MM-dd"), F.date_format(F.date_sub(mid, 1), "yyyy-MM-dd")),
            (F.date_format(mid, "yyyy-MM-dd"), F.date_format("hi", "yyyy-MM-dd")),
        )
    else:
        raise ValueError(f"Unknown period preset '{preset}'")
    return ends.select(
        names[0].alias("period1"),
        spans[0][0].alias("start1"),
        spans[0][1].alias("end1"),
        names[1].alias("period2"),
        spans[1][0].alias("start2"),
        spans[1][1].alias("end2"),
    )


def compare_time_windows(
    df: DataFrame,
    date_col: str,
    first: tuple[str, str, str],
    second: tuple[str, str, str],
) -> DataFrame:
    """Mean of each numeric column in two (name, first day, last day) periods and its relative change.

    Both ends are inclusive days. The bounds are literals, so a date column prunes files and row groups; a
    period without rows gives no result rows.
    """
    require_columns(df, date_col)
    names = numeric_columns(df, exclude=[date_col])
    if not names:
        raise ValueError("There is no numeric column to compare")
    t = parse_timestamp(ref(date_col), field_type(df, date_col))

    def inside(period: tuple[str, str, str]):
        low = F.lit(period[1]).cast("timestamp_ntz")
        high = F.date_add(F.lit(period[2]).cast("date"), 1).cast("timestamp_ntz")
        return (t >= low) & (t < high)

    in1, in2 = inside(first), inside(second)
    measures = [F.count_if(in1).alias("rows1"), F.count_if(in2).alias("rows2")]
    structs = []
    for i, c in enumerate(names):
        measures.append(F.avg(F.when(in1, ref(c))).alias(f"a{i}"))
        measures.append(F.avg(F.when(in2, ref(c))).alias(f"b{i}"))
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(f"a{i}", 4).alias("p1_mean"),
                F.round(f"b{i}", 4).alias("p2_mean"),
            )
        )
    row = df.where(in1 | in2).agg(*measures).where((F.col("rows1") > 0) & (F.col("rows2") > 0))
    long = row.select("rows1", "rows2", F.inline(F.array(*structs)))
    long = long.where(F.col("p1_mean").isNotNull() & F.col("p2_mean").isNotNull())
    base = F.abs("p1_mean")
    change = F.when(base < 1e-10, 0.0).otherwise(
        F.round((F.col("p2_mean") - F.col("p1_mean")) / base * 100, 1)
    )
    long = long.withColumn("pct_change", change)
    direction = (
        F.when(F.abs("pct_change") < 1, "flat").when(F.col("pct_change") > 0, "up").otherwise("down")
    )
    return long.select(
        "column",
        F.lit(first[0]).alias("period1"),
        F.lit(second[0]).alias("period2"),
        "rows1",
        "rows2",
        "p1_mean",
        "p2_mean",
        "pct_change",
        direction.alias("direction"),
        (F.abs("pct_change") >= 20).alias("notable"),
    )


def compare_preset(df: DataFrame, date_col: str, preset: str) -> DataFrame:
    """``compare_time_windows`` over a preset. Its one row of bounds is read first, to become literals."""
    b = period_bounds(df, date_col, preset).first()
    return compare_time_windows(
        df, date_col, (b.period1, b.start1, b.end1), (b.period2, b.start2, b.end2)
    )
