"""Rankings, rolling averages, trends, thinning and forecasts over ordered rows.

Row order is always an argument. Positions come from ``row_positions``, which needs no single-task sort.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import (
    field_type,
    ladder_up_to,
    parse_timestamp,
    ref,
    require_columns,
    require_numeric,
)
from framewise.functions.quantiles import weighted_median
from framewise.functions.scale import row_positions, with_halo
from framewise.operators.profile import day_gaps

MAX_POINTS = 500


def _columns(names: Sequence[str]) -> list[Column]:
    return [ref(n) for n in names]


def rolling_average(
    df: DataFrame,
    order_by: Sequence[str],
    value: str,
    window: int = 7,
    key: Sequence[str] = (),
) -> DataFrame:
    """Trailing mean over the present values of each row's window, per series key.

    A series of n rows uses max(2, min(window, n // 3)) rows, or 1 when n < 6. Long series are cut into
    chunks that carry the rows before them, so no task sorts a whole series.
    """
    require_numeric(df, value)
    rows = row_positions(df, _columns(order_by), "_pos", key)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")) if key else rows.agg(
        F.count(F.lit(1)).alias("_n")
    )
    if key:
        sizes = sizes.select(*[ref(k).alias(f"_s_{k}") for k in key], "_n")
        same = F.lit(True)
        for k in key:
            same = same & ref(k).eqNullSafe(F.col(f"_s_{k}"))
        rows = rows.join(sizes, same).drop(*[f"_s_{k}" for k in key])
    else:
        rows = rows.crossJoin(F.broadcast(sizes))
    return _trailing_mean(rows, value, window, key).select(
        *_columns(df.columns), "rolling_avg"
    )


def _trailing_mean(rows: DataFrame, value: str, window: int, key: Sequence[str] = ()) -> DataFrame:
    """Adds ``rolling_avg`` to rows that carry ``_pos`` and the series size ``_n``."""
    width = max(2, window)
    span = F.when(
        F.col("_n") >= 6,
        F.greatest(F.lit(2), F.least(F.lit(window), F.floor(F.col("_n") / 3).cast("int"))),
    ).otherwise(F.lit(1))
    chunked = with_halo(rows, "_pos", width - 1)
    trailing = (
        Window.partitionBy(*_columns(key), "_chunk").orderBy("_pos").rowsBetween(-(width - 1), 0)
    )
    # The window holds at most ``width`` values; the last ``span`` of them count.
    recent = F.collect_list(F.struct(ref(value).cast("double").alias("v"))).over(trailing)
    with_recent = chunked.withColumn("_w", recent).where("_own")
    used = F.filter(
        F.transform(
            F.slice("_w", -F.least(span, F.size("_w")), F.least(span, F.size("_w"))),
            lambda s: s.getField("v"),
        ),
        lambda v: v.isNotNull(),
    )
    total = F.aggregate(used, F.lit(0.0), lambda a, b: a + b)
    mean = F.when(F.size(used) > 0, F.round(total / F.size(used), 4))
    return with_recent.withColumn("rolling_avg", mean).drop("_w", "_chunk", "_own")


def linear_trend(df: DataFrame, order_by: Sequence[str], value: str) -> DataFrame:
    """Least-squares line over row positions; rows without a value get a point on it too."""
    require_numeric(df, value)
    rows = row_positions(df, _columns(order_by), "_pos")
    return _trend(rows, value).select(*_columns(df.columns), "trend")


def _trend(rows: DataFrame, value: str) -> DataFrame:
    x, y = F.col("_pos").cast("double"), ref(value).cast("double")
    line = rows.agg(
        F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_b"), F.count(y).alias("_c")
    )
    fit = F.when(F.col("_c") >= 2, F.round(F.col("_m") * x + F.col("_b"), 4))
    return rows.crossJoin(F.broadcast(line)).withColumn("trend", fit).drop("_m", "_b", "_c")


def _dated(df: DataFrame, date: str, values: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    t = parse_timestamp(ref(date), field_type(df, date))
    picked = [c for c in dict.fromkeys([*values, *tie_break]) if c != date]
    return df.select(t.alias(date), *_columns(picked)).where(ref(date).isNotNull())


def thin(
    df: DataFrame, order_by: Sequence[str], max_points: int = MAX_POINTS
) -> DataFrame:
    """Every (n // max_points)-th row in order, so between one and two times ``max_points`` rows stay."""
    rows = row_positions(df, _columns(order_by), "_pos")
    return _thin(rows, max_points).orderBy("_pos").select(*_columns(df.columns))


def _thin(rows: DataFrame, max_points: int) -> DataFrame:
    size = rows.agg(F.count(F.lit(1)).alias("_all"))
    step = F.when(
        F.col("_all") > max_points, F.floor(F.col("_all") / max_points).cast("long")
    ).otherwise(F.lit(1).cast("long"))
    stepped = rows.crossJoin(F.broadcast(size)).withColumn("_step", step)
    kept = stepped.where(F.col("_pos") % F.col("_step") == 0)
    return kept.withColumn("_pos", (F.col("_pos") / F.col("_step")).cast("long")).drop("_step", "_all")


def timeseries(
    df: DataFrame,
    date: str,
    value: str,
    window: int = 7,
    tie_break: Sequence[str] = (),
    max_points: int = MAX_POINTS,
) -> DataFrame:
    """Sorted, thinned series with its rolling average and linear trend (chart data)."""
    require_numeric(df, value)
    rows = _dated(df, date, [value], tie_break)
    placed = row_positions(rows, _columns([date, *tie_break]), "_pos")
    points = _thin(placed, max_points)
    # Thinned: fewer than 2 * max_points rows from here on.
    size = points.agg(F.count(F.lit(1)).alias("_n"))
    points = _trailing_mean(points.crossJoin(F.broadcast(size)), value, window)
    points = _trend(points, value)
    return points.select(
        F.col("_pos").alias("point"), ref(date), ref(value), "rolling_avg", "trend"
    ).orderBy("point")


def overlay(
    df: DataFrame,
    date: str,
    values: Sequence[str],
    tie_break: Sequence[str] = (),
    max_points: int = MAX_POINTS,
) -> DataFrame:
    """Several numeric columns on one sorted, thinned date axis."""
    for v in values:
        require_numeric(df, v)
    rows = _dated(df, date, values, tie_break)
    placed = row_positions(rows, _columns([date, *tie_break]), "_pos")
    points = _thin(placed, max_points)
    return points.select(F.col("_pos").alias("point"), ref(date), *_columns(values)).orderBy("point")


def spec_timeseries(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete (x, y) pairs sorted by x."""
    require_columns(df, x, y)
    return df.select(ref(x), ref(y)).dropna().orderBy(ref(x), ref(y))


def top_n(
    df: DataFrame,
    sort_col: str,
    n: int = 10,
    ascending: bool = False,
    display_cols: Sequence[str] | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The 1-50 rows with the highest (or lowest) value, ranked, with at most 8 columns."""
    require_numeric(df, sort_col)
    n = max(1, min(n, 50))
    shown = [c for c in (display_cols or df.columns) if c in df.columns and c != sort_col][:7]
    order = ref(sort_col).asc() if ascending else ref(sort_col).desc()
    ties = _columns(tie_break)
    head = df.where(ref(sort_col).isNotNull()).orderBy(order, *ties).limit(n)
    # At most 50 rows are left for the rank.
    rank = F.row_number().over(Window.orderBy(order, *ties))
    return head.withColumn("_rank", rank).select("_rank", ref(sort_col), *_columns(shown))


def detect_frequency(df: DataFrame, date: str, key: Sequence[str] = ()) -> DataFrame:
    """Median gap between neighbouring dates as day, week, month or quarter, with the step in days."""
    require_columns(df, date, *key)
    gaps = day_gaps(df, date, key)
    median = weighted_median(F.col("gap"), F.col("weight")).alias("median_gap")
    row = gaps.groupBy(*_columns(key)).agg(median) if key else gaps.agg(median)
    return row.select(*_columns(key), *_frequency(F.col("median_gap")))


def _frequency(median: Column) -> list[Column]:
    gap = F.coalesce(median, F.lit(30.0))
    label = ladder_up_to(gap, [(1.5, "day"), (8, "week"), (45, "month")], "quarter")
    step = F.when(gap <= 1.5, 1).when(gap <= 8, 7).otherwise(F.bround(gap).cast("int"))
    return [median.alias("median_gap"), label.alias("period_label"), step.cast("int").alias("step_days")]


def first_last_change(df: DataFrame, order_by: Sequence[str], value: str) -> DataFrame:
    """One row: first and last present value in order and the change in percent of |first|."""
    require_numeric(df, value)
    rows = df.where(ref(value).isNotNull())
    order = F.struct(*_columns(order_by))
    ends = rows.agg(
        F.min_by(ref(value), order).cast("double").alias("first_value"),
        F.max_by(ref(value), order).cast("double").alias("last_value"),
    )
    change = (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100
    return ends.withColumn("pct_change", F.when(F.col("first_value") != 0, F.round(change, 1)))


# --- forecast ---------------------------------------------------------------------------------

FEATURES = ("x0", "x1", "x2", "x3", "x4")


def _calendar_features(t: Column, index: Column) -> list[Column]:
    """Trend index and the yearly and weekly cycle."""
    month = F.lit(2 * np.pi / 12) * F.month(t)
    day = F.lit(2 * np.pi / 7) * F.weekday(t)
    parts = [index.cast("double"), F.sin(month), F.cos(month), F.sin(day), F.cos(day)]
    return [p.alias(name) for p, name in zip(parts, FEATURES)]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coefficients of each series from its 5 x 5 covariance matrix (minimum norm when it is singular)."""
    k = len(FEATURES)
    for batch in batches:
        out = []
        for cov, cross in zip(batch["_cov"], batch["_cross"]):
            full = np.zeros((k, k))
            upper = np.triu_indices(k)
            full[upper] = cov
            full = full + np.triu(full, 1).T
            # Unit scale keeps the cutoff for singular directions meaningful next to a long trend index.
            scale = np.sqrt(np.diag(full))
            scale[scale < 1e-12] = 1.0
            unit = full / np.outer(scale, scale)
            out.append((np.linalg.pinv(unit, rcond=1e-10) @ (np.asarray(cross) / scale)) / scale)
        yield batch.drop(columns=["_cov", "_cross"]).assign(_beta=out)


def forecast(
    df: DataFrame,
    date: str,
    value: str,
    periods: int = 6,
    key: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    include_history: bool = False,
) -> DataFrame:
    """Least-squares forecast of the next 1-24 steps of each series with a 95 % band.

    The model is linear in the row index, the month cycle and the weekday cycle. A series enters the solver
    as its means and covariances, summed over the cluster, never as rows, so its length does not matter.
    Series with fewer than 4 points give no rows.
    """
    require_numeric(df, value)
    require_columns(df, *key)
    periods = max(1, min(periods, 24))
    keys = list(key)
    t = parse_timestamp(ref(date), field_type(df, date))
    rows = df.select(
        *_columns(keys),
        t.alias("_t"),
        ref(value).cast("double").alias("_y"),
        *[ref(c).alias(f"_tie_{c}") for c in tie_break],
    ).where(F.col("_t").isNotNull() & F.col("_y").isNotNull())
    order = [F.col("_t"), *[F.col(f"_tie_{c}") for c in tie_break]]
    placed = row_positions(rows, order, "_i", keys)
    points = placed.select(
        *_columns(keys), "_t", "_y", "_i", *_calendar_features(F.col("_t"), F.col("_i"))
    )
    cov = [
        F.covar_pop(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]
    ]
    moments = points.groupBy(*_columns(keys)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_t").alias("_end"),
        F.max_by("_y", "_i").alias("_last"),
        F.avg("_y").alias("_my"),
        F.var_pop("_y").alias("_vy"),
        F.array(*[F.avg(x) for x in FEATURES]).alias("_mx"),
        F.array(*cov).alias("_cov"),
        F.array(*[F.covar_pop(x, "_y") for x in FEATURES]).alias("_cross"),
    ).where(F.col("_n") >= 4)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema if f.name not in ("_cov",)]
    fields = [f for f in fields if "_cross" not in f] + ["_beta array<double>"]
    kept = moments.withColumn("_cross2", F.col("_cross"))
    solved = kept.mapInPandas(
        _solve, ", ".join([*fields[:-1], "_cross2 array<double>", fields[-1]])
    )

    def dot(a: str | Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)

    # With an intercept, the residual sum of squares is n * (var(y) - beta . cov(x, y)).
    rest = F.greatest(F.col("_vy") - dot("_beta", F.col("_cross2")), F.lit(0.0))
    # What is left of an exact fit is rounding noise of the variance itself.
    rest = F.when(rest > F.col("_vy") * 1e-12, rest).otherwise(0.0)
    models = solved.select(
        *_columns(keys),
        "_n",
        "_end",
        "_last",
        "_beta",
        (F.col("_my") - dot("_beta", F.col("_mx"))).alias("_c"),
        (F.sqrt(rest * F.col("_n") / (F.col("_n") - 1)) * 1.96).alias("_half"),
    )
    steps = detect_frequency(rows.select(*_columns(keys), "_t"), "_t", keys)
    if keys:
        models = models.join(steps, keys)
    else:
        models = models.crossJoin(F.broadcast(steps))
    future = models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    when = F.timestamp_micros(
        F.unix_micros(F.col("_end").cast("timestamp"))
        + F.col("step").cast("long") * F.col("step_days").cast("long") * F.lit(86_400_000_000)
    ).cast("timestamp_ntz")
    future = future.withColumn("_t", when)
    x = F.array(*_calendar_features(F.col("_t"), F.col("_n") + F.col("step") - 1))
    future = future.withColumn("_p", F.col("_c") + dot("_beta", x))
    final = F.max_by("_p", "step").over(Window.partitionBy(*keys)) if keys else F.max_by(
        "_p", "step"
    ).over(Window.partitionBy())
    growth = F.when(F.col("_last") == 0, 0.0).otherwise(
        F.round((final - F.col("_last")) / F.abs("_last") * 100, 1)
    )
    result = future.withColumn("growth_pct", growth).select(
        *_columns(keys),
        "step",
        F.col("_t").alias("date"),
        F.round("_p", 4).alias("value"),
        F.round(F.col("_p") - F.col("_half"), 4).alias("lower"),
        F.round(F.col("_p") + F.col("_half"), 4).alias("upper"),
        "period_label",
        "growth_pct",
    )
    trend = F.when(F.col("growth_pct") > 2, "up").when(F.col("growth_pct") < -2, "down")
    result = result.withColumn("trend", trend.otherwise("stable"))
    if not include_history:
        return result
    history = placed.select(
        *_columns(keys),
        (F.col("_i") + 1).cast("int").alias("step"),
        F.col("_t").alias("date"),
        F.round("_y", 4).alias("value"),
    ).withColumn("kind", F.lit("historical"))
    return history.unionByName(
        result.withColumn("kind", F.lit("forecast")), allowMissingColumns=True
    )


def daily_totals(df: DataFrame, date: str, value: str, agg: str = "sum") -> DataFrame:
    """One row per calendar day: the usual step before a trend over raw rows."""
    require_numeric(df, value)
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg]
    t = parse_timestamp(ref(date), field_type(df, date))
    return df.groupBy(F.to_date(t).alias(date)).agg(fn(ref(value)).alias(value))
