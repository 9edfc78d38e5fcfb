"""Prediction-log monitoring.

The log, feedback and runs are views over the events, nation and customer tables: every event is a prediction
of deployment ``d<user_id % 23>``; deployments are the nations, so two of them never predicted anything; every
third deployment predicts labels, the others numbers.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from framewise.catalog.base import LINEITEM_KEY, Tables, register
from framewise.catalog.grouping import rounded
from framewise.operators import joins, ml, monitoring, validation
from framewise.sources import logs
from framewise.streaming import drift as streamed_drift
from framewise.streaming import monitoring as streamed

AS_OF = "2024-02-01"


def prediction_log(t: Tables):
    k = F.col("user_id") % 23
    label = k % 3 == 2
    return t.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("d"), k.cast("string")).alias("deployment_id"),
        F.to_json(F.struct("user_id", "event_type")).alias("input_features"),
        F.when(label, logs.json_scalar(F.col("event_type")))
        .otherwise((F.col("value") / 7).cast("string"))
        .alias("prediction"),
        F.when(~label, F.col("value") / 7).alias("prediction_numeric"),
        F.lit(None).cast("double").alias("confidence"),
        F.col("ts").alias("created_at"),
    )


def feedback(t: Tables):
    k = F.col("user_id") % 23
    label = k % 3 == 2
    off = 1 + ((F.col("event_id") + k) % 7 - 3) * k / 60
    return t.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("d"), k.cast("string")).alias("deployment_id"),
        F.when(F.col("event_id") % 6 != 5, F.col("event_id").cast("string")).alias("prediction_log_id"),
        F.when(~label & (F.col("event_id") % 4 != 0), F.col("value") / 7 * off).alias("actual_value"),
        F.when(label, F.when(F.col("event_id") % (k + 2) == 0, "view").otherwise(F.col("event_type"))).alias(
            "actual_label"
        ),
        F.when(F.col("event_id") % 11 == 0, F.lit(False)).alias("is_correct"),
        F.lit(None).cast("string").alias("comment"),
        F.col("ts").alias("created_at"),
    )


def deployments(t: Tables):
    k = F.col("n_nationkey")
    start = F.lit("2024-01-01").cast("date")
    return t.nation.select(
        F.concat(F.lit("d"), k.cast("string")).alias("id"),
        F.concat(F.lit("model "), k.cast("string")).alias("algorithm"),
        F.when(k % 3 == 2, "classification").otherwise("regression").alias("problem_type"),
        (k % 7 != 6).alias("is_active"),
        F.date_sub(start, k).cast("timestamp_ntz").alias("created_at"),
        F.date_sub(start, k * 5).cast("timestamp_ntz").alias("trained_at"),
    )


def runs(t: Tables):
    """Customers as training runs, one project per nation."""
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project_id"),
        F.col("c_mktsegment").alias("algorithm"),
        F.lit("regression").alias("problem_type"),
        F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("done").alias("status"),
        F.col("c_custkey").alias("created_at"),
        (F.col("c_acctbal") / 9973).alias("r2"),
        F.abs("c_acctbal").alias("mae"),
        (F.abs("c_acctbal") * 1.5).alias("rmse"),
        F.lit(None).cast("double").alias("accuracy"),
        F.lit(None).cast("double").alias("f1"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
    )


LOG = """log AS (SELECT event_id::VARCHAR AS id, 'd' || (user_id % 23) AS deployment_id,
  (user_id % 23) % 3 = 2 AS is_label, event_type AS label,
  CASE WHEN (user_id % 23) % 3 <> 2 THEN value / 7 END AS v, ts, user_id FROM events)"""
DEP = """dep AS (SELECT 'd' || n_nationkey AS id, 'model ' || n_nationkey AS algorithm,
  CASE WHEN n_nationkey % 3 = 2 THEN 'classification' ELSE 'regression' END AS problem_type,
  n_nationkey % 7 <> 6 AS is_active, DATE '2024-01-01' - n_nationkey AS created_at,
  DATE '2024-01-01' - n_nationkey * 5 AS trained_at FROM nation)"""
FB = """fb AS (SELECT event_id::VARCHAR AS id, 'd' || (user_id % 23) AS deployment_id,
  CASE WHEN event_id % 6 <> 5 THEN event_id::VARCHAR END AS prediction_log_id,
  CASE WHEN (user_id % 23) % 3 <> 2 AND event_id % 4 <> 0 THEN
    value / 7 * (1 + ((event_id + user_id % 23) % 7 - 3) * (user_id % 23) / 60) END AS actual_value,
  CASE WHEN (user_id % 23) % 3 = 2 THEN CASE WHEN event_id % (user_id % 23 + 2) = 0 THEN 'view'
    ELSE event_type END END AS actual_label,
  CASE WHEN event_id % 11 = 0 THEN false
    WHEN (user_id % 23) % 3 = 2 AND event_id % 6 <> 5
      THEN (CASE WHEN event_id % (user_id % 23 + 2) = 0 THEN 'view' ELSE event_type END) = event_type
    END AS is_correct FROM events)"""

# --- logs -------------------------------------------------------------------------------------


def _scored(t: Tables):
    rows = t.events.withColumn("prediction", F.col("value") * 2).withColumn("confidence", F.lit(0.5))
    made = logs.prediction_log(
        rows, "d0", ["user_id", "event_type"], ["event_id"], F.col("ts").cast("timestamp_ntz")
    )
    return made.select(
        "deployment_id",
        "input_features",
        F.get_json_object("input_features", "$.user_id").cast("long").alias("user_id"),
        F.round("prediction_numeric", 4).alias("prediction_numeric"),
        "confidence",
        F.length("id").alias("id_length"),
    )


register(
    "prediction_log_rows",
    _scored,
    """SELECT 'd0' AS deployment_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}'
      AS input_features, user_id, round(value * 2, 4) AS prediction_numeric, 0.5::DOUBLE AS confidence,
      64 AS id_length FROM events""",
)

register(
    "feedback_records",
    lambda t: rounded(
        logs.feedback_records(feedback(t), prediction_log(t)).select(
            "id", "deployment_id", "actual_value", "actual_label", "is_correct"
        ),
        "actual_value",
        digits=4,
    ),
    f"""WITH {FB} SELECT id, deployment_id, round(actual_value, 4) AS actual_value, actual_label, is_correct FROM fb
    WHERE actual_value IS NOT NULL OR actual_label IS NOT NULL""",
)

register(
    "prediction_log_page",
    lambda t: logs.prediction_log_page(prediction_log(t), "d5", limit=15, offset=10).select(
        "id", "prediction", F.col("input_features")["event_type"].alias("event_type")
    ),
    f"""WITH {LOG} SELECT id, label AS prediction, label AS event_type FROM log WHERE deployment_id = 'd5'
    ORDER BY ts DESC, id LIMIT 15 OFFSET 10""",
)

register(
    "pair_feedback",
    lambda t: rounded(
        joins.pair_feedback(feedback(t), prediction_log(t)).select(
            "deployment_id", "prediction_log_id", "actual_value", "prediction_numeric"
        ),
        "actual_value",
        "prediction_numeric",
        digits=4,
    ),
    f"""WITH {LOG}, {FB} SELECT fb.deployment_id, prediction_log_id, round(actual_value, 4) AS actual_value,
      round(v, 4) AS prediction_numeric
    FROM fb JOIN log ON log.id = prediction_log_id WHERE actual_value IS NOT NULL AND v IS NOT NULL""",
)

# --- usage and drift --------------------------------------------------------------------------

register(
    "daily_counts",
    lambda t: monitoring.predictions_by_day(prediction_log(t)),
    f"""WITH {LOG} SELECT deployment_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS count
    FROM log GROUP BY 1, 2""",
)

register(
    "daily_counts_last_week",
    lambda t: monitoring.predictions_by_day(prediction_log(t), days=7, as_of="2024-01-30"),
    f"""WITH {LOG} SELECT deployment_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS count
    FROM log WHERE ts >= DATE '2024-01-24' AND ts < DATE '2024-01-31' GROUP BY 1, 2""",
)

register(
    "pred_hist",
    lambda t: monitoring.prediction_histogram(prediction_log(t)),
    f"""WITH {LOG}, s AS (SELECT deployment_id, min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS recent_avg
      FROM log WHERE v IS NOT NULL GROUP BY 1),
    b AS (SELECT deployment_id, least(floor((v - lo) / ((hi - lo) / 10)), 9)::INT AS bucket, lo,
      (hi - lo) / 10 AS w, recent_avg FROM log JOIN s USING (deployment_id) WHERE v IS NOT NULL)
    SELECT deployment_id, bucket, round(lo + bucket * w, 2) AS lower, round(lo + (bucket + 1) * w, 2) AS upper,
      count(*) AS count, recent_avg FROM b GROUP BY deployment_id, bucket, lo, w, recent_avg""",
)

register(
    "class_counts",
    lambda t: monitoring.class_counts(prediction_log(t)),
    f"""WITH {LOG} SELECT deployment_id, label, count(*) AS count FROM log WHERE is_label GROUP BY 1, 2""",
)

register(
    "deployment_usage",
    lambda t: monitoring.deployment_usage(prediction_log(t)).withColumn(
        "last_predicted_at", F.date_format("last_predicted_at", "yyyy-MM-dd HH:mm:ss")
    ),
    f"""WITH {LOG} SELECT deployment_id, count(*) AS request_count,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_predicted_at FROM log GROUP BY 1""",
)

_EDGES = """r AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, id) AS a,
    row_number() OVER (PARTITION BY deployment_id ORDER BY ts DESC, id DESC) AS z,
    count(*) OVER (PARTITION BY deployment_id) AS n FROM log)"""

register(
    "first_last_windows",
    lambda t: monitoring.first_last_windows(prediction_log(t), 15).select("deployment_id", "window", "id"),
    f"""WITH {LOG}, {_EDGES} SELECT deployment_id, 'baseline' AS "window", id FROM r WHERE a <= 15
    UNION ALL SELECT deployment_id, 'recent', id FROM r WHERE z <= 15""",
)

_DRIFT_N = f"""{_EDGES}, dn AS (SELECT deployment_id, any_value(n) AS n,
    avg(v) FILTER (a <= 20) AS bm, stddev_pop(v) FILTER (a <= 20) AS bs,
    avg(v) FILTER (z <= 20) AS rm, stddev_pop(v) FILTER (z <= 20) AS rs FROM r GROUP BY 1),
  zn AS (SELECT *, CASE WHEN n >= 40 THEN abs(rm - bm) / (bs + 1e-9) END AS q FROM dn)"""

register(
    "drift_num",
    lambda t: monitoring.drift_numeric(prediction_log(t)),
    f"""WITH {LOG}, {_DRIFT_N} SELECT deployment_id, n AS predictions,
      CASE WHEN q IS NULL THEN 'insufficient_data' WHEN q < 1 THEN 'stable' WHEN q < 2 THEN 'mild_drift'
        ELSE 'significant_drift' END AS status, CASE WHEN q IS NOT NULL THEN least(100, floor(q * 33))::INT END AS drift_score,
      CASE WHEN q IS NOT NULL THEN round(bm, 4) END AS baseline_mean,
      CASE WHEN q IS NOT NULL THEN round(bs, 4) END AS baseline_std,
      CASE WHEN q IS NOT NULL THEN round(rm, 4) END AS recent_mean,
      CASE WHEN q IS NOT NULL THEN round(rs, 4) END AS recent_std FROM zn""",
)

_DRIFT_C = """sh AS (SELECT deployment_id, w, lab, round(count(*) / sum(count(*)) OVER
      (PARTITION BY deployment_id, w), 4) AS p FROM (
    SELECT deployment_id, 'b' AS w, CASE WHEN is_label THEN label ELSE {num} END AS lab FROM r WHERE a <= 20
    UNION ALL SELECT deployment_id, 'r', CASE WHEN is_label THEN label ELSE {num} END FROM r WHERE z <= 20)
    GROUP BY 1, 2, 3),
  tv AS (SELECT deployment_id, sum(abs(coalesce(pr, 0) - coalesce(pb, 0))) / 2 AS d FROM (
    SELECT deployment_id, lab, max(p) FILTER (w = 'b') AS pb, max(p) FILTER (w = 'r') AS pr FROM sh GROUP BY 1, 2)
    GROUP BY 1),
  cd AS (SELECT deployment_id, n, CASE WHEN n >= 40 THEN round(d, 10) END AS d FROM tv
    JOIN (SELECT deployment_id, count(*) AS n FROM log GROUP BY 1) USING (deployment_id))""".replace(
    "{num}", "v::VARCHAR"
)

_STATUS_C = """CASE WHEN d IS NULL THEN 'insufficient_data' WHEN d < 0.1 THEN 'stable'
  WHEN d < 0.25 THEN 'mild_drift' ELSE 'significant_drift' END"""

register(
    "drift_cat",
    lambda t: monitoring.drift_categorical(prediction_log(t)),
    f"""WITH {LOG}, {_EDGES}, {_DRIFT_C} SELECT deployment_id, n AS predictions, {_STATUS_C} AS status,
      CASE WHEN d IS NOT NULL THEN least(100, floor(round(d * 200, 8)))::INT END AS drift_score, round(d, 4) AS tvd FROM cd""",
)

register(
    "class_windows",
    lambda t: monitoring.class_windows(prediction_log(t).where(F.col("prediction_numeric").isNull())),
    f"""WITH {LOG.replace('FROM events)', 'FROM events WHERE (user_id % 23) % 3 = 2)')}, {_EDGES}, {_DRIFT_C}
    SELECT deployment_id, lab AS label, coalesce(max(p) FILTER (w = 'b'), 0) AS baseline_share,
      coalesce(max(p) FILTER (w = 'r'), 0) AS recent_share FROM sh GROUP BY 1, 2""",
)

_DRIFT = """dr AS (SELECT dep.id AS deployment_id, dep.problem_type, coalesce(n, 0) AS predictions,
    coalesce(s, 'insufficient_data') AS status, sc AS drift_score FROM dep LEFT JOIN (
      SELECT deployment_id, 'regression' AS k, n, CASE WHEN q IS NULL THEN 'insufficient_data'
        WHEN q < 1 THEN 'stable' WHEN q < 2 THEN 'mild_drift' ELSE 'significant_drift' END AS s,
        CASE WHEN q IS NOT NULL THEN least(100, floor(q * 33))::INT END AS sc FROM zn
      UNION ALL SELECT deployment_id, 'classification', n, {status},
        CASE WHEN d IS NOT NULL THEN least(100, floor(round(d * 200, 8)))::INT END FROM cd) x
    ON x.deployment_id = dep.id AND x.k = dep.problem_type)""".replace("{status}", _STATUS_C)

register(
    "drift",
    lambda t: monitoring.drift(deployments(t), prediction_log(t)),
    f"WITH {LOG}, {DEP}, {_DRIFT_N}, {_DRIFT_C}, {_DRIFT} SELECT * FROM dr",
)

# --- the same over streams --------------------------------------------------------------------


def _streams(t: Tables) -> SimpleNamespace:
    return SimpleNamespace(events=t.stream("events"), nation=t.nation)


def _drift_streamed(t: Tables):
    ends = streamed_drift.prediction_ends(prediction_log(_streams(t)), delay="400 days")
    found = streamed_drift.latest(t.drained(streamed_drift.drift_stream(ends, deployments(t)), "update"))
    return found.select("deployment_id", "problem_type", "predictions", "status", "drift_score")


register(
    "drift_streamed",
    _drift_streamed,
    f"WITH {LOG}, {DEP}, {_DRIFT_N}, {_DRIFT_C}, {_DRIFT} SELECT * FROM dr WHERE predictions > 0",
)


def _drift_alerts_streamed(t: Tables):
    ends = streamed_drift.prediction_ends(prediction_log(_streams(t)), delay="400 days")
    moved = t.drained(streamed_drift.drift_stream(ends, deployments(t).where("is_active")), "update")
    last = streamed_drift.latest(moved).where("drift_score >= 60")
    severity = F.when(F.col("drift_score") >= 80, "critical").otherwise("warning")
    return last.select("deployment_id", severity.alias("severity"), F.col("drift_score").cast("double").alias("value"))


register(
    "drift_alerts_streamed",
    _drift_alerts_streamed,
    f"""WITH {LOG}, {DEP}, {_DRIFT_N}, {_DRIFT_C}, {_DRIFT} SELECT deployment_id,
      CASE WHEN drift_score >= 80 THEN 'critical' ELSE 'warning' END AS severity, drift_score::DOUBLE AS value
    FROM dr JOIN dep ON dep.id = deployment_id WHERE is_active AND drift_score >= 60""",
)

register(
    "predictions_by_day_streamed",
    lambda t: t.drained(streamed.predictions_by_day(prediction_log(_streams(t)), "400 days"), "complete"),
    f"""WITH {LOG} SELECT deployment_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS count FROM log GROUP BY 1, 2""",
)


def _paired_streamed(t: Tables):
    paired = streamed.pair_feedback(feedback(_streams(t)), prediction_log(_streams(t)), "1 day", "400 days")
    found = t.drained(paired).where(F.col("prediction_numeric").isNotNull() & F.col("actual_value").isNotNull())
    return rounded(
        found.select("deployment_id", "prediction_log_id", "actual_value", "prediction_numeric"),
        "actual_value",
        "prediction_numeric",
        digits=4,
    )


register(
    "feedback_paired_streamed",
    _paired_streamed,
    f"""WITH {LOG}, {FB} SELECT fb.deployment_id, prediction_log_id, round(actual_value, 4) AS actual_value,
      round(v, 4) AS prediction_numeric FROM fb JOIN log ON log.id = prediction_log_id
    WHERE actual_value IS NOT NULL AND v IS NOT NULL""",
)

# --- feedback, health and alerts --------------------------------------------------------------

_FACTS = """tot AS (SELECT deployment_id, count(*) AS total, count(actual_value) AS vals,
    count(*) FILTER (is_correct) AS ok, count(*) FILTER (NOT is_correct) AS bad FROM fb2 GROUP BY 1),
  prs AS (SELECT fb2.deployment_id, count(*) AS np, avg(abs(actual_value - v)) AS mae, avg(actual_value) AS av
    FROM fb2 JOIN log ON log.id = prediction_log_id WHERE actual_value IS NOT NULL AND v IS NOT NULL GROUP BY 1),
  fx AS (SELECT dep.id AS deployment_id, dep.problem_type, coalesce(total, 0) AS total, coalesce(vals, 0) AS vals,
    coalesce(np, 0) AS np, coalesce(ok, 0) + coalesce(bad, 0) AS rated, mae, av,
    CASE WHEN dep.problem_type = 'regression' AND np > 0 THEN mae / (abs(av) + 1e-9) * 100 END AS pct,
    CASE WHEN dep.problem_type <> 'regression' AND ok + bad > 0 THEN ok / (ok + bad) END AS acc
    FROM dep LEFT JOIN tot ON tot.deployment_id = dep.id LEFT JOIN prs ON prs.deployment_id = dep.id),
  jd AS (SELECT *, CASE WHEN pct < 5 OR acc >= 0.9 THEN 'excellent' WHEN pct < 15 OR acc >= 0.75 THEN 'good'
    WHEN pct < 30 OR acc >= 0.6 THEN 'moderate' WHEN coalesce(pct, acc) IS NOT NULL THEN 'poor' END AS verdict
    FROM fx)"""
# Records with an outcome are the feedback that was stored.
_FB2 = "fb2 AS (SELECT * FROM fb WHERE actual_value IS NOT NULL OR actual_label IS NOT NULL)"


def stored_feedback(t: Tables):
    return logs.feedback_records(feedback(t), prediction_log(t))


register(
    "feedback_accuracy",
    lambda t: monitoring.feedback_accuracy(deployments(t), stored_feedback(t), prediction_log(t)),
    f"""WITH {LOG}, {DEP}, {FB}, {_FB2}, {_FACTS} SELECT deployment_id, problem_type,
      CASE WHEN total = 0 THEN 'no_feedback' WHEN coalesce(pct, acc) IS NULL THEN 'feedback_only'
        ELSE 'computed' END AS status, total AS total_feedback, vals AS actual_values,
      CASE WHEN problem_type = 'regression' THEN np END AS paired_count,
      CASE WHEN problem_type <> 'regression' THEN rated END AS rated_count,
      CASE WHEN problem_type = 'regression' THEN round(mae, 4) END AS mae, round(pct, 2) AS pct_error,
      CASE WHEN problem_type = 'regression' THEN round(av, 4) END AS avg_actual, round(acc, 4) AS accuracy,
      verdict FROM jd""",
)

register(
    "health",
    lambda t: monitoring.model_health(
        deployments(t), prediction_log(t), stored_feedback(t), AS_OF
    ).withColumn("recommendations", F.concat_ws(",", "recommendations")),
    f"""WITH {LOG}, {DEP}, {FB}, {_FB2}, {_DRIFT_N}, {_DRIFT_C}, {_DRIFT}, {_FACTS},
    h AS (SELECT dep.id AS deployment_id, (DATE '{AS_OF}' - trained_at)::INT AS age,
      CASE verdict WHEN 'excellent' THEN 100 WHEN 'good' THEN 75 WHEN 'moderate' THEN 50 WHEN 'poor' THEN 20
        ELSE 100 END AS f, CASE dr.status WHEN 'stable' THEN 100 WHEN 'mild_drift' THEN 60
        WHEN 'significant_drift' THEN 25 ELSE 100 END AS d, total > 0 AS hf, predictions >= 40 AS hd
      FROM dep JOIN jd ON jd.deployment_id = dep.id JOIN dr ON dr.deployment_id = dep.id),
    s AS (SELECT *, CASE WHEN age <= 30 THEN 100 WHEN age <= 60 THEN 75 WHEN age <= 90 THEN 50 ELSE 25 END AS a
      FROM h),
    c AS (SELECT *, (CASE WHEN hf AND hd THEN (f * 40 + d * 35 + a * 25) // 100 WHEN hf THEN (f * 55 + a * 45) // 100
      WHEN hd THEN (d * 60 + a * 40) // 100 ELSE a END)::INT AS score FROM s)
    SELECT deployment_id, age AS model_age_days, a AS age_score, CASE WHEN hf THEN f END AS feedback_score,
      CASE WHEN hd THEN d END AS drift_score, score AS health_score,
      CASE WHEN score >= 75 THEN 'healthy' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS status,
      concat_ws(',', CASE WHEN a < 75 THEN 'retrain_for_freshness' END,
        CASE WHEN hf AND f < 75 THEN 'accuracy_declining' END, CASE WHEN hd AND d < 75 THEN 'drift_detected' END,
        CASE WHEN NOT hf THEN 'record_feedback' END) AS recommendations FROM c""",
)

register(
    "alerts",
    lambda t: monitoring.alerts(deployments(t), prediction_log(t), stored_feedback(t), AS_OF),
    f"""WITH {LOG}, {DEP}, {FB}, {_FB2}, {_DRIFT_N}, {_DRIFT_C}, {_DRIFT}, {_FACTS},
    g AS (SELECT id, algorithm, (DATE '{AS_OF}' - trained_at)::INT AS age,
      (DATE '{AS_OF}' - created_at)::INT AS old FROM dep WHERE is_active)
    SELECT id AS deployment_id, algorithm, CASE WHEN age > 90 THEN 'critical' ELSE 'warning' END AS severity,
      'stale_model' AS type, age::DOUBLE AS value FROM g WHERE age > 60
    UNION ALL SELECT id, algorithm, 'warning', 'no_predictions', old::DOUBLE FROM g
      WHERE old >= 1 AND id NOT IN (SELECT deployment_id FROM log)
    UNION ALL SELECT id, algorithm, CASE WHEN drift_score >= 80 THEN 'critical' ELSE 'warning' END,
      'drift_detected', drift_score::DOUBLE FROM g JOIN dr ON deployment_id = id WHERE drift_score >= 60
    UNION ALL SELECT id, algorithm, CASE WHEN acc < 0.5 THEN 'critical' ELSE 'warning' END, 'poor_feedback',
      round(acc, 4) FROM g JOIN jd ON deployment_id = id WHERE rated >= 3 AND acc < 0.7
    UNION ALL SELECT id, algorithm, CASE WHEN pct > 50 THEN 'critical' ELSE 'warning' END, 'poor_feedback',
      round(pct, 4) FROM g JOIN jd ON deployment_id = id WHERE vals >= 3 AND pct > 30""",
)

# --- training runs ----------------------------------------------------------------------------

_RUNS = """runs AS (SELECT c_custkey AS id, 'p' || c_nationkey AS project_id, c_mktsegment AS algorithm,
  c_acctbal / 9973 AS r2, abs(c_acctbal) AS mae, abs(c_acctbal) * 1.5 AS rmse,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer
  WHERE c_mktsegment <> 'BUILDING')"""

register(
    "metric_trend",
    lambda t: monitoring.metric_trend(runs(t), "r2"),
    f"""WITH {_RUNS}, s AS (SELECT project_id, count(*) AS runs, regr_slope(r2, i) AS k, avg(r2) AS m,
      max(r2) AS hi, min(r2) AS lo, arg_max(r2, i) AS last FROM runs GROUP BY 1),
    h AS (SELECT *, greatest(greatest(hi - lo, 1e-9) * 0.01, abs(m) * 0.02, 1e-6) AS t FROM s)
    SELECT project_id, runs, round(hi, 4) AS best_metric, round(last, 4) AS latest_metric,
      CASE WHEN runs < 2 THEN 'insufficient_data' WHEN k > t THEN 'improving' WHEN k < -t THEN 'declining'
        ELSE 'stable' END AS trend FROM h""",
)

register(
    "run_drop",
    lambda t: monitoring.run_drop(runs(t), "r2"),
    f"""WITH {_RUNS}, l AS (SELECT project_id, max(i) AS mi, arg_max(r2, i) AS latest FROM runs GROUP BY 1),
    b AS (SELECT project_id, latest, max(r2) AS best FROM runs JOIN l USING (project_id) WHERE i < mi
      GROUP BY 1, 2)
    SELECT project_id, round(latest, 4) AS latest_metric, round(best, 4) AS best_earlier,
      coalesce(best > 0 AND (best - latest) / best > 0.02, false) AS flagged FROM b""",
)

register(
    "pick_best",
    lambda t: ml.pick_best(runs(t)),
    f"""WITH {_RUNS} SELECT id AS model_run_id, algorithm, 'R²' AS metric, round(r2, 3) AS score FROM runs
    ORDER BY r2 DESC, id LIMIT 1""",
)

register(
    "compare_models",
    lambda t: ml.compare_models(runs(t)).select("id", "algorithm", "r2", "mae", "rmse", "recommended"),
    f"""WITH {_RUNS} SELECT id, algorithm, r2, mae, rmse,
      id = (SELECT id FROM runs ORDER BY r2 DESC, id LIMIT 1) AS recommended FROM runs""",
)

register(
    "radar",
    lambda t: ml.radar_data(runs(t)),
    f"""WITH {_RUNS}, m AS (SELECT max(mae) AS a, max(rmse) AS b FROM runs)
    SELECT id, algorithm, 'R²' AS metric, round(greatest(0, least(1, r2)), 3) AS value FROM runs
    UNION ALL SELECT id, algorithm, 'MAE Score', round(greatest(0, 1 - mae / a), 3) FROM runs, m
    UNION ALL SELECT id, algorithm, 'RMSE Score', round(greatest(0, 1 - rmse / b), 3) FROM runs, m""",
)

register(
    "confidence",
    lambda t: validation.confidence(
        t.customer.select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_nationkey") % 2 == 0, "regression").otherwise("classification").alias("problem_type"),
            (F.col("c_custkey") + 1).alias("n_rows"),
            (F.col("c_nationkey") * 4).alias("n_features"),
            F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") / 100).alias("cv_std"),
            F.round(F.col("c_acctbal") / 10000, 3).alias("r2"),
            F.round(F.col("c_acctbal") / 10000, 3).alias("accuracy"),
            F.lit(None).cast("double").alias("f1"),
        )
    ).withColumn("limitations", F.concat_ws(",", "limitations")),
    """WITH c AS (SELECT c_custkey AS id, c_nationkey % 2 = 0 AS reg, c_custkey + 1 AS n, c_nationkey * 4 AS p,
      CASE WHEN c_nationkey <> 3 THEN c_nationkey / 100 END AS sd, round(c_acctbal / 10000, 3) AS s FROM customer),
    l AS (SELECT *, concat_ws(',', CASE WHEN n < 100 THEN 'small_dataset' END,
      CASE WHEN sd > 0.1 THEN 'unstable_cross_validation' END, CASE WHEN reg AND s < 0.5 THEN 'low_r2' END,
      CASE WHEN NOT reg AND s < 0.7 THEN 'low_accuracy' END,
      CASE WHEN p > n * 0.5 THEN 'too_many_features' END) AS x FROM c)
    SELECT id, CASE WHEN s >= 0.85 AND (sd IS NULL OR sd < 0.05) THEN 'high' WHEN s >= 0.65 THEN 'medium'
      ELSE 'low' END AS overall_confidence, CASE WHEN x = '' THEN 'none' ELSE x END AS limitations FROM l""",
)

# --- scored tables ----------------------------------------------------------------------------


def scored_numbers(t: Tables):
    """Prices against a formula."""
    return t.lineitem.select(
        *LINEITEM_KEY,
        "l_returnflag",
        "l_quantity",
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_extendedprice") * 0.8 + F.col("l_quantity") * 300 + F.col("l_linenumber") * 500).alias(
            "predicted"
        ),
    )


def scored_labels(t: Tables):
    """Return flags against a rule."""
    guess = (
        F.when(F.col("l_discount") > 0.06, "R").when(F.col("l_quantity") > 25, "A").otherwise("N")
    )
    return t.lineitem.select(
        *LINEITEM_KEY,
        "l_linestatus",
        F.col("l_returnflag").alias("actual"),
        guess.alias("predicted"),
    )


NUM = """sn AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
  l_extendedprice AS y, l_extendedprice * 0.8 + l_quantity * 300 + l_linenumber * 500 AS p FROM lineitem)"""
LAB = """sl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag AS y,
  CASE WHEN l_discount > 0.06 THEN 'R' WHEN l_quantity > 25 THEN 'A' ELSE 'N' END AS p FROM lineitem)"""

register(
    "reg_metrics",
    lambda t: validation.regression_metrics(scored_numbers(t)),
    f"""WITH {NUM} SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2,
      round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, count(*) AS n FROM sn""",
)

_PER_CLASS = """k AS (SELECT l AS label, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS claimed,
    count(*) FILTER (y = l AND p = l) AS tp FROM {t}, (SELECT unnest({labels}) AS l) GROUP BY l),
  q AS (SELECT *, tp / claimed AS pr, tp / support AS rc, 2 * (tp / claimed) * (tp / support)
    / (tp / claimed + tp / support) AS f FROM k)"""
_FLAGS = _PER_CLASS.replace("{t}", "sl").replace("{labels}", "['A', 'N', 'R']")

register(
    "cls_metrics",
    lambda t: validation.classification_metrics(scored_labels(t)),
    f"""WITH {LAB}, {_FLAGS} SELECT round(sum(tp) / sum(support), 4) AS accuracy,
      round(sum(f * support) / sum(support), 4) AS f1, round(sum(pr * support) / sum(support), 4) AS precision,
      round(sum(rc * support) / sum(support), 4) AS recall, sum(support)::BIGINT AS n FROM q""",
)

register(
    "cls_metrics_binary",
    lambda t: validation.classification_metrics(
        t.lineitem.select(
            F.col("l_linestatus").alias("actual"),
            F.when(F.col("l_quantity") > 20, "O").otherwise("F").alias("predicted"),
        )
    ),
    """WITH s AS (SELECT l_linestatus AS y, CASE WHEN l_quantity > 20 THEN 'O' ELSE 'F' END AS p FROM lineitem), """
    + _PER_CLASS.replace("{t}", "s").replace("{labels}", "['F', 'O']")
    + """ SELECT round((SELECT sum(tp) / sum(support) FROM q), 4) AS accuracy, round(f, 4) AS f1,
      round(pr, 4) AS precision, round(rc, 4) AS recall, (SELECT sum(support)::BIGINT FROM q) AS n
    FROM q WHERE label = 'O'""",
)

register(
    "confusion",
    lambda t: validation.confusion(scored_labels(t)),
    f"WITH {LAB} SELECT y AS actual, p AS predicted, count(*) AS n FROM sl GROUP BY 1, 2",
)

register(
    "confusion_matrix",
    lambda t: validation.confusion_matrix(scored_labels(t)),
    f"""WITH {LAB} SELECT y AS actual, count(*) FILTER (p = 'A') AS "A", count(*) FILTER (p = 'N') AS "N",
      count(*) FILTER (p = 'R') AS "R" FROM sl GROUP BY 1""",
)

register(
    "confusion_summary",
    lambda t: validation.confusion_summary(scored_labels(t)),
    f"""WITH {LAB}, {_FLAGS} SELECT sum(support)::BIGINT AS total, sum(tp)::BIGINT AS correct,
      round(sum(tp) / sum(support), 4) AS accuracy, arg_min(label, rc) AS worst_class,
      round(min(rc), 4) AS worst_recall FROM q""",
)

register(
    "residuals",
    lambda t: validation.residual_summary(scored_numbers(t)),
    f"""WITH {NUM} SELECT round(avg(abs(y - p)), 4) AS mae, round(avg(y - p), 4) AS bias,
      round(stddev_pop(y - p), 4) AS std, round(quantile_cont(abs(y - p), 0.75), 4) AS percentile_75,
      round(quantile_cont(abs(y - p), 0.9), 4) AS percentile_90,
      CASE WHEN abs(avg(y - p)) / stddev_pop(y) < 0.02 THEN 'none' WHEN avg(y - p) > 0 THEN 'under-prediction'
        ELSE 'over-prediction' END AS bias_label FROM sn""",
)

register("residual_sample", lambda t: validation.residual_sample(scored_numbers(t), LINEITEM_KEY))

_LADDER_R = """CASE WHEN m >= 0.85 THEN 'strong' WHEN m >= {a} THEN 'moderate' WHEN m >= {b} THEN 'weak'
  WHEN m IS NOT NULL THEN 'poor' ELSE 'insufficient_data' END"""


def _segment_sql(base: str, table: str, group: str, metric: str, a: float, b: float) -> str:
    return f"""WITH {base}, g AS (SELECT {group}::VARCHAR AS segment, count(*) AS n, {metric} AS r FROM {table}
      GROUP BY 1 ORDER BY n DESC, segment LIMIT 15),
    s AS (SELECT segment, n, CASE WHEN n >= 2 THEN round(r, 4) END AS m FROM g)
    SELECT segment, n, m AS metric, {_LADDER_R.format(a=a, b=b)} AS status, n < 10 AS low_sample,
      segment = (SELECT arg_max(segment, (m, n)) FROM s) AS is_best,
      segment = (SELECT arg_min(segment, (m, n)) FROM s) AS is_worst,
      round((SELECT max(m) - min(m) FROM s), 4) AS gap FROM s"""


register(
    "segment_perf",
    lambda t: validation.checked_segment_performance(
        t.lineitem, scored_numbers(t), "l_returnflag"
    ),
    _segment_sql(
        NUM, "sn", "l_returnflag", "greatest(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), -1)", 0.65, 0.4
    ),
)

register(
    "segment_perf_cls",
    lambda t: validation.segment_performance(scored_labels(t), "l_linestatus", "classification"),
    _segment_sql(LAB, "sl", "l_linestatus", "avg((y = p)::INT)", 0.7, 0.5),
)

register(
    "errors_reg",
    lambda t: rounded(
        validation.prediction_errors(scored_numbers(t), LINEITEM_KEY, n=30, features=["l_quantity"]),
        "predicted",
        "error",
        "abs_error",
        digits=2,
    ),
    f"""WITH {NUM} SELECT row_number() OVER (ORDER BY abs(y - p) DESC, l_orderkey, l_linenumber, l_partkey,
      l_suppkey) AS rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(y, 4) AS actual,
      round(round(p, 4), 2) AS predicted, round(round(y - p, 4), 2) AS error,
      round(round(abs(y - p), 4), 2) AS abs_error, l_quantity FROM sn ORDER BY rank LIMIT 30""",
)

register(
    "errors_cls",
    lambda t: validation.prediction_errors(scored_labels(t), LINEITEM_KEY, "classification", n=20),
    f"""WITH {LAB} SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank,
      l_orderkey, l_linenumber, l_partkey, l_suppkey, y AS actual, p AS predicted,
      (SELECT count(*) FROM sl WHERE y <> p) AS total_errors,
      (SELECT round(count(*) FILTER (y <> p) / count(*), 4) FROM sl) AS error_rate
    FROM sl WHERE y <> p ORDER BY rank LIMIT 20""",
)

register(
    "explain",
    lambda t: validation.explain_rows(
        t.part.select("p_partkey", "p_size", "p_retailprice"),
        ["p_partkey"],
        {"p_size": 0.7, "p_retailprice": 0.3},
        {"p_size": 25.0, "p_retailprice": 950.0},
        {"p_size": 15.0, "p_retailprice": 0.0},
    ),
    """WITH c AS (SELECT p_partkey, 'p_size' AS feature, round(p_size::DOUBLE, 4) AS value,
        25.0::DOUBLE AS mean_value, round(0.7 * (p_size - 25.0::DOUBLE) / 15.0, 6) AS contribution FROM part
      UNION ALL SELECT p_partkey, 'p_retailprice', round(p_retailprice, 4), 950.0,
        round(0.3::DOUBLE * (p_retailprice - 950.0), 6) FROM part)
    SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(contribution) DESC, feature) AS rank,
      feature, value, mean_value, contribution,
      CASE WHEN contribution >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM c""",
)
