"""Usage, drift, feedback, health and alerts over prediction logs, and trends over training runs.

Tables: log (id, deployment_id, prediction JSON, prediction_numeric, created_at), feedback (deployment_id,
prediction_log_id, actual_value, is_correct), deployments (id, algorithm, problem_type, is_active, created_at,
trained_at). A deployment with a large part of the log is handled by partial aggregation and rank limits that
act inside each task, so no task receives a deployment's whole log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import ladder, ladder_below, ladder_up_to, ref, seconds
from framewise.functions.ends import first_last
from framewise.functions.scale import broadcast_if_few, freeze, row_positions
from framewise.operators.joins import pair_feedback
from framewise.sources.logs import json_label

WINDOW = 20
BUCKETS = 10
HEALTH_MIN_LOGS = 40
# Bounds of the verdicts.
ERROR_STEPS = [(5, "excellent"), (15, "good"), (30, "moderate")]
ACCURACY_STEPS = [(0.9, "excellent"), (0.75, "good"), (0.6, "moderate")]
FEEDBACK_SCORES = {"excellent": 100, "good": 75, "moderate": 50, "poor": 20}
DRIFT_SCORES = {"stable": 100, "mild_drift": 60, "significant_drift": 25}


def predictions_by_day(log: DataFrame, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Predictions per deployment and calendar day, of the last ``days`` days up to ``as_of`` when given."""
    rows = log
    if days is not None:
        end = F.lit(as_of).cast("date") if as_of else F.current_date()
        low = F.date_sub(end, days - 1).cast("timestamp_ntz")
        high = F.date_add(end, 1).cast("timestamp_ntz")
        at = F.col("created_at").cast("timestamp_ntz")
        rows = log.where((at >= low) & (at < high))
        if "log_date" in log.columns:
            # The folders of those days alone are read, with a day to spare for the writer's time zone.
            rows = rows.where(F.col("log_date").between(F.date_sub(end, days), F.date_add(end, 1)))
    return rows.groupBy(
        "deployment_id", F.date_format("created_at", "yyyy-MM-dd").alias("date")
    ).agg(F.count(F.lit(1)).alias("count"))


def prediction_histogram(log: DataFrame) -> DataFrame:
    """Non-empty buckets (ten equal ones, or one for a constant) per deployment, with the overall mean."""
    rows = log.where(F.col("prediction_numeric").isNotNull()).select(
        "deployment_id", F.col("prediction_numeric").alias("_v")
    )
    spans = rows.groupBy("deployment_id").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.round(F.avg("_v"), 4).alias("recent_avg")
    )
    # A row per deployment: the log is not shuffled on its few ids.
    spans = broadcast_if_few(spans)
    width = (F.col("_hi") - F.col("_lo")) / BUCKETS
    spot = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BUCKETS - 1)))
    placed = rows.join(spans, "deployment_id").select(
        "deployment_id",
        "_lo",
        "_hi",
        "recent_avg",
        F.coalesce(spot, F.lit(0)).cast("int").alias("bucket"),
    )
    counts = placed.groupBy("deployment_id", "bucket", "_lo", "_hi", "recent_avg").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.select(
        "deployment_id",
        "bucket",
        F.round(F.col("_lo") + F.col("bucket") * width, 2).alias("lower"),
        F.round(F.col("_lo") + (F.col("bucket") + 1) * width, 2).alias("upper"),
        "count",
        "recent_avg",
    )


def class_counts(log: DataFrame) -> DataFrame:
    """Predictions per deployment and label, of the predictions that are not numbers."""
    rows = log.where(F.col("prediction_numeric").isNull()).select(
        "deployment_id", json_label(F.col("prediction")).alias("label")
    )
    return rows.where(F.col("label").isNotNull()).groupBy("deployment_id", "label").agg(
        F.count(F.lit(1)).alias("count")
    )


def deployment_usage(log: DataFrame) -> DataFrame:
    """Requests and time of the latest prediction per deployment."""
    return log.groupBy("deployment_id").agg(
        F.count(F.lit(1)).alias("request_count"), F.max("created_at").alias("last_predicted_at")
    )


def first_last_windows(log: DataFrame, n: int = WINDOW) -> DataFrame:
    """The first and last n predictions of each deployment, tagged ``baseline`` and ``recent``.

    Rows that are early and late at once appear under both tags. The rank limit is applied in each task before
    the shuffle, so n rows per task and deployment travel.
    """

    def edge(tag: str, *order: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("deployment_id").orderBy(*order))
        return log.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn").withColumn(
            "window", F.lit(tag)
        )

    first = edge("baseline", F.asc("created_at"), F.asc("id"))
    return first.unionByName(edge("recent", F.desc("created_at"), F.desc("id")))


def _capped_score(value: Column) -> Column:
    """Whole score of at most 100; ``least`` alone would turn a missing one into 100."""
    return F.when(value.isNotNull(), F.least(F.lit(100), F.floor(value))).cast("int")


def log_ends(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per deployment: predictions (their number), first and last (its first and last ``window`` predictions), in one
    reading of the log. Elements hold created_at, id, prediction_numeric and prediction."""
    ends = first_last(log, "deployment_id", ["created_at", "id"], window, ["prediction_numeric", "prediction"])
    return ends.withColumnRenamed("rows", "predictions")


def _moments(rows: str) -> tuple[Column, Column, Column]:
    """Count, mean and population deviation of the numeric predictions of an array of log rows."""
    values = F.filter(F.transform(rows, lambda r: r["prediction_numeric"]), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.when(n > 0, n)
    around = F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), _welford, lambda s: s["s"])
    return n, mean, F.sqrt(around / F.when(n > 0, n))


def _welford(s: Column, v: Column) -> Column:
    n, off = s["n"] + 1, v - s["m"]
    mean = s["m"] + off / n
    return F.struct(n.alias("n"), mean.alias("m"), (s["s"] + off * (v - mean)).alias("s"))


def numeric_drift_columns(window: int = WINDOW) -> dict[str, Column]:
    """Shift of the mean prediction between ``first`` and ``last`` of ``log_ends`` rows. Works on streams too."""
    (bn, bm, bs), (rn, rm, rs) = _moments("first"), _moments("last")
    enough = (F.col("predictions") >= 2 * window) & (bn > 0) & (rn > 0)
    z = F.when(enough, F.abs(rm - bm) / (bs + 1e-9))
    status = ladder_below(z, [(1.0, "stable"), (2.0, "mild_drift")], "significant_drift")
    facts = {"baseline_mean": bm, "baseline_std": bs, "recent_mean": rm, "recent_std": rs}
    return {
        "status": F.coalesce(status, F.lit("insufficient_data")),
        "drift_score": _capped_score(z * 33),
        **{name: F.when(enough, F.round(c, 4)) for name, c in facts.items()},
    }


def class_drift_columns(window: int = WINDOW, digits: int | None = 4) -> dict[str, Column]:
    """Total variation distance of the label shares between ``first`` and ``last`` of ``log_ends`` rows. Works on streams too."""

    def labels(rows: str) -> Column:
        return F.transform(rows, lambda r: F.coalesce(json_label(r["prediction"]), F.lit("unknown")))

    first, last = labels("first"), labels("last")

    def share(rows: Column, label: Column) -> Column:
        value = F.size(F.filter(rows, lambda x: x == label)) / F.size(rows)
        return value if digits is None else F.round(value, digits)

    apart = F.aggregate(F.array_union(first, last), F.lit(0.0), lambda s, x: s + F.abs(share(last, x) - share(first, x)))
    d = F.when(F.col("predictions") >= 2 * window, F.round(apart / 2, 10))
    status = ladder_below(d, [(0.1, "stable"), (0.25, "mild_drift")], "significant_drift")
    return {
        "status": F.coalesce(status, F.lit("insufficient_data")),
        "drift_score": _capped_score(F.round(d * 200, 8)),
        "tvd": F.round(d, 4),
    }


def drift_numeric(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """Shift of the mean prediction, last against first window, in baseline standard deviations."""
    return _with(log_ends(log, window), numeric_drift_columns(window))


def _with(ends: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return ends.select("deployment_id", "predictions", *[c.alias(name) for name, c in columns.items()])


def class_windows(log: DataFrame, window: int = WINDOW, digits: int | None = 4) -> DataFrame:
    """Share of each label in the first and last window per deployment; unreadable labels are ``unknown``."""
    label = F.coalesce(json_label(F.col("prediction")), F.lit("unknown"))
    rows = first_last_windows(log, window).select("deployment_id", "window", label.alias("label"))
    counts = rows.groupBy("deployment_id", "window", "label").agg(F.count(F.lit(1)).alias("n"))
    # At most 2 * window rows per deployment from here on.
    whole = F.sum("n").over(Window.partitionBy("deployment_id", "window"))
    share = F.col("n") / whole
    shares = counts.select(
        "deployment_id", "window", "label", (share if digits is None else F.round(share, digits)).alias("p")
    )
    base = shares.where(F.col("window") == "baseline").select("deployment_id", "label", F.col("p").alias("_b"))
    late = shares.where(F.col("window") == "recent").select("deployment_id", "label", F.col("p").alias("_r"))
    return base.join(late, ["deployment_id", "label"], "full").select(
        "deployment_id",
        "label",
        F.coalesce("_b", F.lit(0.0)).alias("baseline_share"),
        F.coalesce("_r", F.lit(0.0)).alias("recent_share"),
    )


def drift_categorical(log: DataFrame, window: int = WINDOW, digits: int | None = 4) -> DataFrame:
    """Total variation distance of the label shares, last against first window."""
    return _with(log_ends(log, window), class_drift_columns(window, digits))


def drift(deployments: DataFrame, log: DataFrame, window: int = WINDOW) -> DataFrame:
    """Drift of each deployment by its problem type; deployments without predictions have too little data."""
    return _drift_of(deployments, log_ends(log, window), window)


def _drift_of(deployments: DataFrame, ends: DataFrame, window: int = WINDOW) -> DataFrame:
    kinds = deployments.select(
        F.col("id").alias("deployment_id"),
        F.coalesce("problem_type", F.lit("regression")).alias("problem_type"),
    )
    found = kinds.join(ends, "deployment_id", "left")
    numeric, classes = numeric_drift_columns(window), class_drift_columns(window)
    by_kind = lambda name: F.when(F.col("problem_type") == "regression", numeric[name]).when(
        F.col("problem_type") == "classification", classes[name]
    )
    known = F.col("predictions").isNotNull()
    return found.select(
        "deployment_id",
        "problem_type",
        F.when(F.col("problem_type").isin("regression", "classification"), F.coalesce("predictions", F.lit(0)))
        .otherwise(0)
        .cast("long")
        .alias("predictions"),
        F.coalesce(F.when(known, by_kind("status")), F.lit("insufficient_data")).alias("status"),
        F.when(known, by_kind("drift_score")).alias("drift_score"),
    )


def _feedback_facts(deployments: DataFrame, feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Unrounded error (regression) and accuracy (classification) of each deployment by its feedback."""
    kinds = deployments.select(
        F.col("id").alias("deployment_id"),
        F.coalesce("problem_type", F.lit("regression")).alias("problem_type"),
    )
    totals = feedback.groupBy("deployment_id").agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count("actual_value").alias("actual_values"),
        F.count_if("is_correct").alias("correct_count"),
        F.count_if(~F.col("is_correct")).alias("incorrect_count"),
    )
    error = F.abs(F.col("actual_value") - F.col("prediction_numeric"))
    pairs = pair_feedback(feedback, log).groupBy("deployment_id").agg(
        F.count(F.lit(1)).alias("paired_count"),
        F.avg(error).alias("_mae"),
        F.avg("actual_value").alias("_avg"),
    )
    rows = kinds.join(totals, "deployment_id", "left").join(pairs, "deployment_id", "left")
    rows = rows.na.fill(
        0, ["total_feedback", "actual_values", "correct_count", "incorrect_count", "paired_count"]
    )
    regression = F.col("problem_type") == "regression"
    rated = F.col("correct_count") + F.col("incorrect_count")
    return rows.withColumns(
        {
            "rated_count": rated,
            "_pct": F.when(
                regression & (F.col("paired_count") > 0), F.col("_mae") / (F.abs("_avg") + 1e-9) * 100
            ),
            "_acc": F.when(~regression & (rated > 0), F.col("correct_count") / rated),
        }
    )


def feedback_accuracy(deployments: DataFrame, feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Error (regression) or accuracy (classification) of each deployment's predictions by its feedback."""
    rows = _feedback_facts(deployments, feedback, log)
    regression = F.col("problem_type") == "regression"
    status = (
        F.when(F.col("total_feedback") == 0, "no_feedback")
        .when(F.col("_pct").isNull() & F.col("_acc").isNull(), "feedback_only")
        .otherwise("computed")
    )
    verdict = F.coalesce(
        ladder_below(F.col("_pct"), ERROR_STEPS, "poor"), ladder(F.col("_acc"), ACCURACY_STEPS, "poor")
    )
    return rows.select(
        "deployment_id",
        "problem_type",
        status.alias("status"),
        "total_feedback",
        "actual_values",
        F.when(regression, F.col("paired_count")).alias("paired_count"),
        F.when(~regression, F.col("rated_count")).alias("rated_count"),
        F.when(regression, F.round("_mae", 4)).alias("mae"),
        F.round("_pct", 2).alias("pct_error"),
        F.when(regression, F.round("_avg", 4)).alias("avg_actual"),
        F.round("_acc", 4).alias("accuracy"),
        verdict.alias("verdict"),
    )


def _age_days(at: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp_ntz")
    days = F.floor((seconds(now) - seconds(at)) / 86400)
    return F.greatest(F.lit(0), F.coalesce(days, F.lit(0))).cast("int")


def _score_of(label: Column, scores: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])[label]


def model_health(deployments: DataFrame, log: DataFrame, feedback: DataFrame, as_of: str) -> DataFrame:
    """Health 0-100 of each deployment from model age, feedback and drift, weighted by what is known."""
    base = deployments.select(
        F.col("id").alias("deployment_id"), _age_days(F.col("trained_at"), as_of).alias("model_age_days")
    )
    judged = feedback_accuracy(deployments, feedback, log).select("deployment_id", "total_feedback", "verdict")
    moved = drift(deployments, log).select("deployment_id", "predictions", F.col("status").alias("_drift"))
    rows = base.join(judged, "deployment_id").join(moved, "deployment_id")
    rows = rows.select(
        "deployment_id",
        "model_age_days",
        ladder_up_to(F.col("model_age_days"), [(30, 100), (60, 75), (90, 50)], 25).alias("age_score"),
        F.coalesce(_score_of(F.col("verdict"), FEEDBACK_SCORES), F.lit(100)).alias("_f"),
        F.coalesce(_score_of(F.col("_drift"), DRIFT_SCORES), F.lit(100)).alias("_d"),
        (F.col("total_feedback") > 0).alias("has_feedback"),
        (F.col("predictions") >= HEALTH_MIN_LOGS).alias("has_drift"),
    )
    age, f, d = F.col("age_score"), F.col("_f"), F.col("_d")
    # Whole-number weights: 0.4 / 0.35 / 0.25 and so on without binary rounding.
    score = (
        F.when(F.col("has_feedback") & F.col("has_drift"), F.floor((f * 40 + d * 35 + age * 25) / 100))
        .when(F.col("has_feedback"), F.floor((f * 55 + age * 45) / 100))
        .when(F.col("has_drift"), F.floor((d * 60 + age * 40) / 100))
        .otherwise(age)
    )
    advice = F.array_compact(
        F.array(
            F.when(age < 75, "retrain_for_freshness"),
            F.when(F.col("has_feedback") & (f < 75), "accuracy_declining"),
            F.when(F.col("has_drift") & (d < 75), "drift_detected"),
            F.when(~F.col("has_feedback"), "record_feedback"),
        )
    )
    return rows.select(
        "deployment_id",
        "model_age_days",
        "age_score",
        F.when(F.col("has_feedback"), f).alias("feedback_score"),
        F.when(F.col("has_drift"), d).alias("drift_score"),
        score.cast("int").alias("health_score"),
        ladder(score, [(75, "healthy"), (50, "warning")], "critical").alias("status"),
        advice.alias("recommendations"),
    )


def alerts(deployments: DataFrame, log: DataFrame, feedback: DataFrame, as_of: str) -> DataFrame:
    """Alerts (deployment_id, algorithm, severity, type, value) of the active deployments, critical first."""
    active = deployments.where(F.col("is_active"))
    named = active.select(F.col("id").alias("deployment_id"), "algorithm")

    def rows(source: DataFrame, kind: str, critical: Column, value: Column) -> DataFrame:
        return source.select(
            "deployment_id",
            F.coalesce("algorithm", F.lit("model")).alias("algorithm"),
            F.when(critical, "critical").otherwise("warning").alias("severity"),
            F.lit(kind).alias("type"),
            F.round(value.cast("double"), 4).alias("value"),
        )

    aged = active.select(
        F.col("id").alias("deployment_id"),
        "algorithm",
        _age_days(F.col("trained_at"), as_of).alias("age"),
        _age_days(F.col("created_at"), as_of).alias("deployed"),
    )
    stale = rows(aged.where(F.col("age") > 60), "stale_model", F.col("age") > 90, F.col("age"))

    # The ends are a row per deployment: drift and the search for unused deployments read the log once.
    ends = freeze(log_ends(log.join(active.select(F.col("id").alias("deployment_id")), "deployment_id", "left_semi")))
    used = ends.select("deployment_id")
    unused = aged.where(F.col("deployed") >= 1).join(used, "deployment_id", "left_anti")
    idle = rows(unused, "no_predictions", F.lit(False), F.col("deployed"))

    moved = _drift_of(active, ends).where(F.col("drift_score") >= 60).join(
        named, "deployment_id"
    )
    drifted = rows(moved, "drift_detected", F.col("drift_score") >= 80, F.col("drift_score"))

    judged = _feedback_facts(active, feedback, log).join(
        named, "deployment_id"
    )
    wrong = judged.where((F.col("rated_count") >= 3) & (F.col("_acc") < 0.7))
    poor_class = rows(wrong, "poor_feedback", F.col("_acc") < 0.5, F.col("_acc"))
    far = judged.where((F.col("actual_values") >= 3) & (F.col("_pct") > 30))
    poor_number = rows(far, "poor_feedback", F.col("_pct") > 50, F.col("_pct"))

    found = stale.unionByName(idle).unionByName(drifted).unionByName(poor_class).unionByName(poor_number)
    return found.orderBy(F.col("severity") == "warning", "deployment_id", "type")


# --- training runs ----------------------------------------------------------------------------


def metric_trend(
    runs: DataFrame, metric: str, group: str = "project_id", order_by: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """Slope of a metric over the finished runs of each project: improving, declining or stable."""
    done = runs.where((F.col("status") == "done") & ref(metric).isNotNull())
    placed = row_positions(done, [ref(c) for c in order_by], "_i", [group])
    x, y = F.col("_i").cast("double"), ref(metric).cast("double")
    stats = placed.groupBy(group).agg(
        F.count(F.lit(1)).alias("runs"),
        F.regr_slope(y, x).alias("slope"),
        F.avg(y).alias("_mean"),
        F.max(y).alias("best_metric"),
        F.min(y).alias("_min"),
        F.max_by(y, F.col("_i")).alias("latest_metric"),
    )
    spread = F.greatest(F.col("best_metric") - F.col("_min"), F.lit(1e-9))
    threshold = F.greatest(spread * 0.01, F.abs("_mean") * 0.02, F.lit(1e-6))
    trend = (
        F.when(F.col("runs") < 2, "insufficient_data")
        .when(F.col("slope") > threshold, "improving")
        .when(F.col("slope") < -threshold, "declining")
        .otherwise("stable")
    )
    return stats.select(
        group,
        "runs",
        F.round("best_metric", 4).alias("best_metric"),
        F.round("latest_metric", 4).alias("latest_metric"),
        trend.alias("trend"),
    )


def run_drop(
    runs: DataFrame, metric: str, group: str = "project_id", order_by: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """Latest finished run of each project against its best earlier one; a fall of over 2 % is flagged."""
    done = runs.where((F.col("status") == "done") & ref(metric).isNotNull())
    order = F.struct(*[ref(c) for c in order_by])
    # Two mergeable aggregates: the latest run, then the best of all others.
    latest = done.groupBy(group).agg(
        F.max(order).alias("_last"), F.max_by(ref(metric), order).alias("latest_metric")
    )
    earlier = done.join(latest, group).where(order < F.col("_last"))
    best = earlier.groupBy(group, "latest_metric").agg(F.max(ref(metric)).alias("best_earlier"))
    fall = F.try_divide(F.col("best_earlier") - F.col("latest_metric"), F.col("best_earlier"))
    return best.select(
        group,
        F.round("latest_metric", 4).alias("latest_metric"),
        F.round("best_earlier", 4).alias("best_earlier"),
        F.coalesce((F.col("best_earlier") > 0) & (fall > 0.02), F.lit(False)).alias("flagged"),
    )
