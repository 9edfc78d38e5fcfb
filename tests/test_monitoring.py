import datetime as dt

import pytest
from pyspark.sql import functions as F

from framewise.operators import joins, ml, monitoring
from framewise.sources import logs, tables
from framewise.streaming import monitoring as streaming

START = dt.datetime(2024, 1, 1)
LOG = "id string, deployment_id string, input_features string, prediction string, prediction_numeric double, confidence double, created_at timestamp_ntz"
FEEDBACK = "id string, deployment_id string, prediction_log_id string, actual_value double, actual_label string, is_correct boolean, comment string, created_at timestamp_ntz"
DEPLOYMENTS = "id string, algorithm string, problem_type string, is_active boolean, created_at timestamp_ntz, trained_at timestamp_ntz"


def log_row(i, dep, value=None, label=None, minutes=None):
    text = str(value) if label is None else f'"{label}"'
    at = START + dt.timedelta(minutes=i if minutes is None else minutes)
    return (f"{dep}-{i:04d}", dep, '{"a": 1}', text, value, None, at)


def feedback_row(i, dep, log_id=None, value=None, label=None, ok=None):
    return (f"f{i}", dep, log_id, value, label, ok, None, START + dt.timedelta(hours=i))


@pytest.mark.parametrize(
    ("n", "shift", "status"),
    [(39, 0.0, "insufficient_data"), (40, 0.0, "stable"), (40, 4.0, "mild_drift"), (60, 40.0, "significant_drift")],
)
def test_numeric_drift(table, n, shift, status):
    rows = [log_row(i, "d", float(i % 5) + (shift if i >= n - 20 else 0.0) * 0.5) for i in range(n)]
    got = monitoring.drift_numeric(table(LOG, rows)).first()
    assert got.status == status
    assert (got.drift_score is None) == (n < 40)


def test_categorical_drift(table):
    rows = [log_row(i, "d", label="cat" if i < 20 or i % 2 else "dog") for i in range(40)]
    got = monitoring.drift_categorical(table(LOG, rows)).first()
    assert (got.status, got.drift_score, got.tvd) == ("significant_drift", 100, 0.5)
    shares = {r.label: (r.baseline_share, r.recent_share) for r in monitoring.class_windows(table(LOG, rows)).collect()}
    assert shares == {"cat": (1.0, 0.5), "dog": (0.0, 0.5)}


def test_rank_limit_runs_before_the_shuffle(spark, tmp_path, table):
    table(LOG, [log_row(i, "d", 1.0) for i in range(5)]).write.parquet(str(tmp_path / "log"))
    plan = monitoring.first_last_windows(spark.read.parquet(str(tmp_path / "log")), 20)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_usage_and_histograms(table):
    rows = [log_row(i, "n", float(i), minutes=i * 600) for i in range(20)] + [log_row(i, "c", 7.0) for i in range(3)]
    rows += [log_row(i, "l", label="cat") for i in range(4)] + [("bad", "l", "{}", "{oops", None, None, START)]
    log = table(LOG, rows)
    assert monitoring.predictions_by_day(log).where("deployment_id = 'n'").count() == 8
    assert monitoring.predictions_by_day(log, days=2, as_of="2024-01-02").where("deployment_id = 'n'").count() == 2
    bars = monitoring.prediction_histogram(log)
    assert [r["count"] for r in bars.where("deployment_id = 'n'").orderBy("bucket").collect()] == [2] * 10
    assert [tuple(r)[1:5] for r in bars.where("deployment_id = 'c'").collect()] == [(0, 7.0, 7.0, 3)]
    assert [tuple(r) for r in monitoring.class_counts(log).collect()] == [("l", "cat", 4)]
    used = {r.deployment_id: r.request_count for r in monitoring.deployment_usage(log).collect()}
    assert used == {"n": 20, "c": 3, "l": 5}


@pytest.fixture
def world(table):
    log = [log_row(i, "good", 100.0 + i % 3) for i in range(45)]
    log += [log_row(i, "off", 100.0) for i in range(45)]
    log += [log_row(i, "lab", label="cat") for i in range(10)]
    fb = [feedback_row(i, "good", f"good-{i:04d}", 100.0 + i % 3) for i in range(5)]
    fb += [feedback_row(i, "off", f"off-{i:04d}", 210.0) for i in range(5)]
    fb += [feedback_row(i, "lab", f"lab-{i:04d}", label="cat" if i < 2 else "dog") for i in range(5)]
    fb += [feedback_row(90, "lab"), feedback_row(91, "only", None, 5.0)]

    def dep(name, kind, age, active=True):
        at = dt.datetime(2024, 2, 1) - dt.timedelta(days=age)
        return (name, f"m-{name}", kind, active, at, at)

    deployments = [dep("good", "regression", 10), dep("off", "regression", 95), dep("lab", "classification", 70),
                   dep("idle", "regression", 5), dep("gone", "regression", 200, False), dep("only", "regression", 0)]
    log_df = table(LOG, log)
    return table(DEPLOYMENTS, deployments), log_df, logs.feedback_records(table(FEEDBACK, fb), log_df)


def test_feedback(world):
    deployments, log, fb = world
    got = {r.deployment_id: r for r in monitoring.feedback_accuracy(deployments, fb, log).collect()}
    assert (got["good"].status, got["good"].verdict, got["good"].paired_count) == ("computed", "excellent", 5)
    assert (got["off"].verdict, got["off"].pct_error) == ("poor", 52.38)
    assert (got["lab"].accuracy, got["lab"].verdict, got["lab"].rated_count) == (0.4, "poor", 5)
    assert (got["idle"].status, got["only"].status) == ("no_feedback", "feedback_only")
    assert joins.pair_feedback(fb, log).count() == 10


def test_health(world):
    deployments, log, fb = world
    got = {r.deployment_id: r for r in monitoring.model_health(deployments, log, fb, "2024-02-01").collect()}
    assert (got["good"].health_score, got["good"].status, got["good"].model_age_days) == (100, "healthy", 10)
    assert got["off"].health_score == int(20 * 0.4 + 100 * 0.35 + 25 * 0.25)
    assert got["lab"].health_score == (20 * 55 + 50 * 45) // 100
    assert got["idle"].health_score == 100 and got["idle"].feedback_score is None
    assert "record_feedback" in got["idle"].recommendations


def test_alerts(world):
    deployments, log, fb = world
    got = [(r.severity, r.deployment_id, r.type) for r in monitoring.alerts(deployments, log, fb, "2024-02-01").collect()]
    assert got == [
        ("critical", "lab", "poor_feedback"), ("critical", "off", "poor_feedback"), ("critical", "off", "stale_model"),
        ("warning", "idle", "no_predictions"), ("warning", "lab", "stale_model"),
    ]


RUNS = "id long, project_id string, status string, created_at long, r2 double"


def test_run_trends(table):
    def project(name, values):
        return [(i, name, "done", i, v) for i, v in enumerate(values)]

    runs = table(RUNS, project("up", [0.5, 0.6, 0.7]) + project("down", [0.9, 0.7, 0.5]) + project("flat", [0.8, 0.8, 0.801])
                 + project("one", [0.4]) + [(9, "up", "failed", 9, 0.1)])
    got = {r.project_id: r for r in monitoring.metric_trend(runs, "r2").collect()}
    assert {k: r.trend for k, r in got.items()} == {"up": "improving", "down": "declining", "flat": "stable",
                                                    "one": "insufficient_data"}
    assert (got["down"].best_metric, got["down"].latest_metric) == (0.9, 0.5)
    drops = {r.project_id: r.flagged for r in monitoring.run_drop(runs, "r2").collect()}
    assert drops == {"up": False, "down": True, "flat": False}
    zero = table(RUNS, project("z", [0.0, 0.0]))
    assert monitoring.run_drop(zero, "r2").first().flagged is False


# --- sources ----------------------------------------------------------------------------------


def test_csv_and_refresh(spark, tmp_path, table):
    df = table("region string, v double", [("a", 1.0), ("b", None), ("c", 3.0)])
    filtered = tables.export_table(df, str(tmp_path / "out"), [{"column": "v", "operator": "gt", "value": 0}])
    assert filtered.endswith("_filtered") and tables.export_name("t.csv", [{}]) == "t_filtered.csv"
    back = tables.read_table(spark, filtered, "csv", "region string, v double")
    assert sorted(r.region for r in back.collect()) == ["a", "c"]
    assert dict(tables.read_table(spark, filtered, "csv").dtypes)["v"] == "double"
    target, report = tables.refresh_table(back.withColumn("w", F.lit(1)).drop("v"), str(tmp_path / "t"), df.columns, ["v"])
    assert tuple(report.first()) == (["w"], ["v"], ["v"], False)
    assert spark.read.parquet(target).count() == 2
    saved, stats = joins.merge_and_profile(df, df.select("region", F.lit(2).alias("z")), "region", "inner", str(tmp_path / "m"))
    assert saved.count() == 3 and stats.count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, filtered, "xlsx")


def test_extract(spark, table):
    table("a long", [(1,), (2,)]).createOrReplaceTempView("numbers_view")
    assert tables.extract_select(spark, "SELECT a FROM numbers_view WHERE a > 1;").count() == 1
    assert tables.extract_select(spark, "numbers_view").count() == 2
    assert "numbers_view" in {r.name for r in tables.list_tables(spark).collect()}
    for bad in ("DROP TABLE numbers_view", "SELECT a FROM numbers_view WHERE a > 9"):
        with pytest.raises(ValueError):
            tables.extract_select(spark, bad)


def test_prediction_log_round_trip(spark, tmp_path, table):
    scored = table("id long, a double, prediction string, confidence double", [(1, 2.0, 'c"at', 0.9), (2, None, "dog", 0.8)])
    rows = logs.prediction_log(scored, "d", ["a"], ["id"], F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"))
    logs.append_prediction_log(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    page = logs.prediction_log_page(log, "d", feature_schema="a double").collect()
    assert {r.prediction for r in page} == {'c"at', "dog"} and {r.input_features.a for r in page} == {2.0, None}
    assert logs.prediction_log_page(log, "d", limit=0).count() == 1
    fb = table(FEEDBACK, [feedback_row(1, "d", page[0].id, label=page[0].prediction), feedback_row(2, "d", "no such", label="x")])
    logs.record_feedback(fb, log, str(tmp_path / "fb"))
    stored = {r.id: r.is_correct for r in spark.read.parquet(str(tmp_path / "fb")).collect()}
    assert stored == {"f1": True, "f2": None}
    with pytest.raises(ValueError):
        logs.record_feedback(table(FEEDBACK, [feedback_row(3, "d")]), log, str(tmp_path / "fb2"))


# --- streams ----------------------------------------------------------------------------------



def test_daily_counts_stream_equals_batch(spark, tmp_path, table):
    log = table(LOG, [log_row(i, f"d{i % 2}", 1.0, minutes=i * 240) for i in range(60)])
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = (
        streaming.predictions_by_day(source, "0 seconds").writeStream.format("memory").queryName("daily").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r.deployment_id, r.date): r["count"] for r in spark.table("daily").collect()}
    want = {(r.deployment_id, r.date): r["count"] for r in monitoring.predictions_by_day(log).collect()}
    assert got == want


def test_scores_stream_into_the_log(spark, tmp_path):
    data = spark.range(60).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "'g' || id % 2 AS g", "2.0 * (id % 7) AS y")
    model = ml.train(data, "linear_regression", ["a", "g"], "y", ["id"])
    data.drop("y").coalesce(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(data.drop("y").schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        streaming.score_stream(source, model, "d1", ["id"], str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 60 and log.select("id").distinct().count() == 60
    assert log.where("prediction_numeric IS NULL OR deployment_id <> 'd1'").count() == 0


def test_feedback_pairs_in_a_stream(spark, tmp_path, table):
    log = table(LOG, [log_row(i, "d", float(i), minutes=i) for i in range(5)] + [log_row(9, "d", 9.0, minutes=60 * 24 * 90)])
    fb = table(FEEDBACK, [feedback_row(i, "d", f"d-{i:04d}", float(i)) for i in range(4)]
               + [feedback_row(5, "d", "missing", 1.0), feedback_row(24 * 90, "d", "later", 1.0)])
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    fb.coalesce(1).write.parquet(str(tmp_path / "fb"))
    pairs = streaming.pair_feedback(
        spark.readStream.schema(fb.schema).parquet(str(tmp_path / "fb")),
        spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")),
    )
    query = pairs.writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.prediction_log_id: r.prediction_numeric for r in spark.table("pairs").collect()}
    # Unpaired feedback comes out once the watermark has passed its horizon.
    assert got == {"d-0000": 0.0, "d-0001": 1.0, "d-0002": 2.0, "d-0003": 3.0, "missing": None}
