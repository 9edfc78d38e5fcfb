"""Results that must not depend on label types, repeated keys, the number of values or the smallest values."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from framewise.functions import scale
from framewise.operators import features, ml, monitoring, profile, quality, scoring, validation
from framewise.plans.features import apply_transforms
from framewise.sources.logs import append_prediction_log


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i, i % 4, float(i % 4), i % 2 == 0, ("a", "b", "c")[i % 3], i % 3) for i in range(90)]
    return spark.createDataFrame(rows, "id int, g int, x double, even boolean, name string, kind int").cache()


def test_boolean_target_is_compared_as_it_was_trained(numbers):
    model = ml.train(numbers, "random_forest_classifier", ["g", "kind"], "even", ["id"], "classification", {"n_estimators": 5, "max_depth": 4})
    row = validation.confusion_summary(scoring.score_batch(numbers, model), "even", "prediction").first()
    assert row.total == 90 and row.accuracy == 1.0


def test_labels_of_different_number_types_are_equal(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (10, 10.0), (10, 2.0)], "actual int, predicted double")
    assert validation.classification_metrics(df).first().accuracy == 0.75
    two = spark.createDataFrame([(2, 2.0), (10, 2.0), (10, 10.0)], "actual int, predicted double")
    assert validation.classification_metrics(two).first().recall == 0.5  # of 10, the larger label


def test_rows_with_one_key_keep_their_own_predictions(numbers):
    target = numbers.withColumn("y", 3 * F.col("id") + 1.0)
    model = ml.train(target, "linear_regression", ["id"], "y", ["id"])
    out = scoring.what_if(target.where("id < 20"), {"id": 0}, model, ["g"])
    assert sorted(r.original_prediction for r in out.collect()) == pytest.approx([3.0 * i + 1 for i in range(20)], abs=0.01)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_band_is_kept_when_the_first_algorithm_fails(numbers, monkeypatch):
    noisy = numbers.withColumn("y", F.col("id") + F.col("kind") * 2.0)
    fit = ml._fit
    monkeypatch.setattr(ml, "_fit", lambda rows, stats, a, p: fit(rows, stats, a, p) if a == "linear_regression" else 1 / 0)
    models = ml.train_many(noisy, ["random_forest_regressor", "linear_regression"], ["id"], "y", ["id"])
    assert "error" in models[0].metrics and models[1].stats.residual_std > 0


def test_boosting_of_three_classes_has_probabilities(numbers):
    model = ml.train(numbers, "gradient_boosting_classifier", ["kind"], "name", ["id"], "classification", {"n_estimators": 3})
    sums = scoring.class_probabilities(numbers, model, ["id"]).groupBy("id").agg(F.sum("probability").alias("s"))
    assert sums.where("abs(s - 1) > 0.001").count() == 0
    assert scoring.score_batch(numbers, model).where("confidence is null").count() == 0


def test_many_values_become_one_sparse_vector(spark):
    df = spark.range(1500).select(F.format_string("n%05d", "id").alias("name"), "id")
    out, made = apply_transforms(df, [{"transform_type": "one_hot", "column": "name"}])
    assert made == {"name": ["name_onehot"]}
    assert out.where(F.array_position(vector_to_array("name_onehot"), F.lit(1.0)) != F.col("id") + 1).count() == 0
    assert features.MAX_DUMMIES < 1500


def test_roles_look_at_all_values(spark):
    rows = [(f"2024-01-{i % 28 + 1:02d}", "x" * 99 + str(i)) for i in range(60)] + [("", "a"), ("", "b"), ("", "c"), ("", "d"), ("", "e")]
    df = spark.createDataFrame(rows, "d string, note string")
    assert profile.insights(df).where("type = 'date_column'").select("column").collect() == [("d",)]
    assert {r.column: r.col_type for r in quality.classify_columns(df).collect()}["note"] == "text"
    assert "date_decompose" in [r.transform_type for r in features.suggest_features(df).where("column = 'd'").collect()]
    assert [r.column for r in profile.detect_time_columns(df).collect()] == ["d"]


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError):
        scale.freeze(type("Frame", (), {"sparkSession": Session()})())


def test_log_is_not_shuffled_on_its_few_deployments(spark):
    rows = [(f"d{i % 2}", float(i)) for i in range(50)]
    log = spark.createDataFrame(rows, "deployment_id string, prediction_numeric double")
    plan = monitoring.prediction_histogram(log)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_day_ranges_prune_the_log_folders(spark, tmp_path):
    log = spark.createDataFrame([("d", f"2024-03-{d:02d} 10:00:00") for d in range(1, 11)], "deployment_id string, at string")
    log = log.select("deployment_id", F.col("at").cast("timestamp").alias("created_at"))
    append_prediction_log(log, str(tmp_path / "log"))
    out = monitoring.predictions_by_day(spark.read.parquet(str(tmp_path / "log")), days=2, as_of="2024-03-05")
    assert sorted(r.date for r in out.collect()) == ["2024-03-04", "2024-03-05"]
    assert "log_date" in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
