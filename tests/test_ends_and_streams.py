import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from framewise.functions import ends
from framewise.operators import monitoring
from framewise.plans import features as plan
from framewise.sources import tables
from framewise.streaming import drift as streaming

START = dt.datetime(2024, 1, 1)
LOG = "id string, deployment_id string, input_features string, prediction string, prediction_numeric double, confidence double, created_at timestamp"


def log_row(i, dep, value=None, label=None, minutes=None):
    text = str(value) if label is None else f'"{label}"'
    at = START + dt.timedelta(minutes=i if minutes is None else minutes)
    return (f"{dep}-{i:04d}", dep, '{"a": 1}', text, value, None, at)


# -- ends -------------------------------------------------------------------------------------


@pytest.mark.parametrize("pending", [ends.PENDING, 3])
def test_ends_equal_sorted_rows(spark, monkeypatch, pending):
    monkeypatch.setattr(ends, "PENDING", pending)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, 1, 2, 3, 50]), i, f"v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, id long, v string").repartition(7).withColumns({"_n": F.lit("x"), "rows": F.lit(1)})
    got = {r["k"]: r for r in ends.first_last(df, "k", ["at", "id"], 5, ["v"]).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for k, r in got.items():
        own = sorted([x[1:] for x in rows if x[0] == k], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert r["rows"] == len(own)
        assert [tuple(x) for x in r["first"]] == own[:5] and [tuple(x) for x in r["last"]] == own[-5:]


def test_ends_of_few_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, at int")
    (r,) = ends.first_last(df, "k", ["at"], 5).collect()
    assert (r["rows"], [x["at"] for x in r["first"]], [x["at"] for x in r["last"]]) == (2, [1, 2], [1, 2])
    assert ends.first_last(df.limit(0), "k", ["at"], 5).collect() == []


def test_drift_alerts_and_health_rank_no_log(spark, tmp_path):
    spark.createDataFrame([log_row(i, "d", 1.0) for i in range(50)], LOG).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    deployments = spark.createDataFrame([("d", "m", "regression", True, START, START)], "id string, algorithm string, problem_type string, is_active boolean, created_at timestamp_ntz, trained_at timestamp_ntz")
    plan = monitoring.drift(deployments, log)._jdf.queryExecution().executedPlan().toString()
    # Numeric and label drift read the log in one scan; the pairs with feedback need a second one, of two columns.
    assert plan.count("FileScan parquet") == 1 and "Window" not in plan
    feedback = spark.createDataFrame([], "deployment_id string, prediction_log_id string, actual_value double, is_correct boolean")
    plan = monitoring.model_health(deployments, log, feedback, "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2 and "Window" not in plan


# -- streams ----------------------------------------------------------------------------------


def history():
    rows = [log_row(i, "num", float(i % 5) + (40.0 if i >= 70 else 0.0)) for i in range(90)]
    rows += [log_row(i, "cls", label="cat" if i < 30 or i % 2 else "dog") for i in range(60)]
    rows += [log_row(i, "few", 1.0) for i in range(7)]
    rows += [log_row(500 + i, "ties", float(i), minutes=5) for i in range(45)]
    random.Random(3).shuffle(rows)
    return rows


def run(spark, folder, sink, **options):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    ends_ = streaming.prediction_ends(stream, **{"delay": "30 days", **options})
    out = streaming.drift_stream(ends_)
    store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/{sink}/batch={number}")
    writer = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/{sink}-state").foreachBatch(store)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{sink}/*")


def test_stream_gives_what_the_batch_gives_also_after_a_restart(spark, tmp_path):
    rows, folder = history(), str(tmp_path)
    for k in range(0, len(rows), 40):
        if k == 120:  # the query ends and starts again in the middle
            run(spark, folder, "out")
        spark.createDataFrame(rows[k : k + 40], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    got = {r["deployment_id"]: r for r in streaming.latest(run(spark, folder, "out")).collect()}
    log = spark.createDataFrame(rows, LOG)
    for r in monitoring.drift_numeric(log).collect():
        own = got[r["deployment_id"]]
        names = ("predictions", "baseline_mean", "baseline_std", "recent_mean", "recent_std")
        assert [own[n] for n in names] == [r[n] for n in names]
        assert (own["numeric_status"], own["numeric_drift_score"]) == (r["status"], r["drift_score"])
    for r in monitoring.drift_categorical(log).collect():
        own = got[r["deployment_id"]]
        assert (own["class_status"], own["class_drift_score"], own["tvd"]) == (r["status"], r["drift_score"], r["tvd"])
    assert got["num"]["numeric_status"] == "significant_drift" and got["cls"]["class_status"] == "significant_drift"


def test_state_is_bounded_and_odd_rows_are_left_out(spark, tmp_path):
    folder = str(tmp_path)
    rows = [log_row(i, "d", None if i % 3 else float(i), label="x" if i % 3 else None) for i in range(300)]
    odd = [("x", None, None, "1", 1.0, None, START), (None, "d", None, "1", 1.0, None, START), ("y", "d", None, "1", 1.0, None, None), ("z", "e", None, None, None, None, START)]
    spark.createDataFrame([*rows, *odd], LOG).write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(LOG).parquet(f"{folder}/log")
    writer = streaming.prediction_ends(stream, window=4).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/c")
    writer.foreachBatch(lambda b, n: b.write.parquet(f"{folder}/out/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    got = {r["deployment_id"]: r for r in spark.read.parquet(f"{folder}/out/*").where("not idle").collect()}
    assert {k: r["predictions"] for k, r in got.items()} == {"d": 300, "e": 1}
    assert [r["id"] for r in got["d"]["first"]] == [f"d-{i:04d}" for i in range(4)]
    assert [(r["id"], r["prediction_numeric"]) for r in got["d"]["last"]] == [(f"d-{i:04d}", None if i % 3 else float(i)) for i in range(296, 300)]


def test_idle_deployments_and_drift_become_alerts(spark, tmp_path):
    folder, day = str(tmp_path), 24 * 60
    parts = [
        [log_row(i, "quiet", 1.0) for i in range(5)],
        [log_row(i, "busy", float(i % 3) + (50 if i > 50 else 0), minutes=4 * day + i) for i in range(80)],
        [log_row(100 + i, "busy", 50.0, minutes=9 * day + i) for i in range(3)],
        [log_row(200 + i, "off", 1.0, minutes=9 * day + i) for i in range(3)],
    ]
    deployments = spark.createDataFrame([("quiet", None, "regression", True), ("busy", "m", None, True), ("off", "m", "regression", False)], "id string, algorithm string, problem_type string, is_active boolean")
    found = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
        alerts = streaming.alert_stream(streaming.prediction_ends(stream, delay="1 hour", idle="2 days"), deployments)
        writer = alerts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/c")
        store = lambda b, n, k=k: b.write.mode("overwrite").parquet(f"{folder}/out/run={k}/batch={n}")
        writer.foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    found = {(r["deployment_id"], r["algorithm"], r["severity"], r["type"]) for r in spark.read.parquet(f"{folder}/out/*/*").collect()}
    assert ("quiet", "model", "warning", "no_predictions") in found and ("busy", "m", "critical", "drift_detected") in found
    assert not any(r[0] == "off" for r in found)


# -- tables and steps -------------------------------------------------------------------------


def test_tables_of_other_types_gaps_and_no_rows(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), None)], "id int, x double, s string")
    new = spark.createDataFrame([(1, "a", None)], "id long, s string, y double")
    got = {r["column"]: tuple(r)[1:] for r in tables.compare_tables(old, new).collect()}
    assert got == {
        "id": ("kept", True, "int", "bigint", 0.0, 0.0, 2, 1),
        "s": ("kept", False, "string", "string", 50.0, 0.0, 2, 1),
        "x": ("removed", False, "double", None, 50.0, None, 2, None),
        "y": ("added", False, None, "double", None, 100.0, None, 1),
    }
    empty = {r["column"]: (r["new_missing_pct"], r["new_rows"]) for r in tables.compare_tables(old, new.limit(0)).collect()}
    assert empty["id"] == (None, 0)


def test_skipped_steps_say_why(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    skipped = {}
    _, made = plan.apply_transforms(df, [{"column": "x", "transform_type": "no_such"}, {"column": "x", "transform_type": "log_transform"}], skipped)
    assert list(made) == ["x"] and list(skipped) == [0] and "no_such" in skipped[0]
