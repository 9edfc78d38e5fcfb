import pytest
from pyspark.sql import functions as F

from framewise.operators import mining, ml, scoring, validation

KEY = ["id"]


@pytest.fixture(scope="module")
def numbers(spark):
    """y = 3a - 2b + a group effect, with a few missing values."""
    return spark.range(400).selectExpr(
        "id", "CAST(id % 37 AS DOUBLE) AS a", "IF(id % 50 = 0, NULL, CAST(id % 11 AS DOUBLE)) AS b",
        "IF(id % 3 = 0, 'x', 'z') AS g", "3.0 * (id % 37) - 2.0 * (id % 11) + IF(id % 3 = 0, 5, 0) AS y"
    ).persist()


@pytest.fixture(scope="module")
def classes(spark):
    return spark.range(300).selectExpr(
        "id", "CAST(id % 30 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "'k' || id % 5 AS g",
        "CASE WHEN id % 30 < 10 THEN 'low' WHEN id % 30 < 20 THEN 'mid' ELSE 'top' END AS y3",
        "IF(id % 30 < 15, 'no', 'yes') AS y2"
    ).persist()


@pytest.fixture(scope="module")
def linear(numbers):
    return ml.train(numbers, "linear_regression", ["a", "b", "g"], "y", KEY)


@pytest.fixture(scope="module")
def forest(classes):
    return ml.train(classes, "random_forest_classifier", ["a", "b", "g"], "y3", KEY, "classification",
                    {"n_estimators": 10, "max_depth": 4})


def test_clusters(table):
    points = [(1.0 + i / 10, 1.0) for i in range(6)] + [(10.0 + i / 10, 10.0) for i in range(4)]
    df = table("x double, y double", points + [(None, 1.0)])
    got = mining.clusters(df).collect()
    assert len(got) == 10
    assert {r.cluster for r in got if r.x < 5} == {0} and {r.cluster for r in got if r.x > 5} == {1}
    profile = mining.cluster_profiles(mining.clusters(df, k=1), ["x", "y"]).collect()
    assert {(r.cluster, r["size"], r.size_pct) for r in profile} == {(0, 6, 60.0), (1, 4, 40.0)}
    assert all(r.distinguishing for r in profile)
    with pytest.raises(ValueError):
        mining.clusters(df.limit(5))


def test_anomalies_rank_injected_rows_first(spark):
    df = spark.range(600).selectExpr(
        "id", "IF(id = 599, 50000.0, 100.0 + id % 17) AS revenue", "IF(id = 598, -999.0, 5.0 + id % 9) AS quantity",
        "IF(id % 40 = 0, NULL, 0.1 * (id % 4)) AS discount"
    )
    columns = ["revenue", "quantity", "discount"]
    top = mining.anomalies(df, columns, KEY, n_top=5).collect()
    assert {r.id for r in top[:2]} == {598, 599} and top[0].anomaly_score == 100.0
    scored = mining.anomaly_scores(df, columns, KEY, contamination=0.1)
    share = scored.where("is_anomaly").count() / 600
    assert 0.02 < share <= 0.11
    again = mining.anomaly_scores(df.repartition(7), columns, KEY, contamination=0.1)
    assert sorted(map(tuple, scored.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    flat = mining.anomaly_scores(spark.range(20).selectExpr("id", "1.0D AS c"), ["c"], KEY)
    assert flat.agg(F.max("anomaly_score")).first()[0] == 0.0
    with pytest.raises(ValueError):
        mining.anomaly_scores(df, ["nope"], KEY)


def test_split_is_stable(numbers):
    a = ml.split(numbers.repartition(1), KEY)[1].count()
    b = ml.split(numbers.repartition(13), KEY)[1].count()
    assert a == b and 40 < a < 130
    fit_rows, test_rows = ml.split(numbers.limit(5), KEY)
    assert fit_rows.count() == test_rows.count() == 5


def test_linear_model(linear):
    assert linear.metrics["r2"] > 0.95
    assert linear.stats.medians["b"] in (4.0, 5.0, 6.0)
    weights = ml.importance_map(linear)
    assert sum(weights.values()) == pytest.approx(1, abs=1e-4)


def test_scores_have_bands_and_defaults(linear, table):
    rows = table("id long, a double, b double, g string", [(1, None, None, "x"), (2, 3.0, 1.0, "never"), (3, 3.0, 1.0, None)])
    got = {r.id: r for r in scoring.score_batch(rows, linear).collect()}
    half = 1.96 * linear.stats.residual_std
    assert got[1].upper - got[1].prediction == pytest.approx(half, abs=1e-3)
    assert (got[1].unseen, got[2].unseen, got[3].unseen) == (0, 1, 1)
    # An unseen category scores like the first known one.
    known = table("id long, a double, b double, g string", [(2, 3.0, 1.0, "x")])
    assert scoring.score_batch(known, linear).first().prediction == got[2].prediction
    assert scoring.score_batch(rows.drop("a"), linear).count() == 3


def test_what_if_and_scenarios(linear, numbers):
    rows = numbers.limit(20)
    got = scoring.what_if(rows, {"a": 0.0}, linear, KEY).collect()
    assert all(r.delta == pytest.approx(r.modified_prediction - r.original_prediction, abs=1e-3) for r in got)
    cases = scoring.scenarios(rows, linear, KEY, [("low", {"a": 0.0}), ("high", {"a": 36.0})]).collect()
    assert len(cases) == 40 and all(r.is_best == (r.scenario == "high") for r in cases)
    with pytest.raises(ValueError):
        scoring.scenarios(rows, linear, KEY, [])
    with pytest.raises(ValueError):
        scoring.scenarios(rows, linear, KEY, [(str(i), {}) for i in range(11)])
    with pytest.raises(ValueError):
        scoring.what_if(rows, {"nope": 1}, linear, KEY)


def test_saved_models_score_the_same(linear, numbers, tmp_path, spark):
    scoring.save_model(linear, str(tmp_path / "m"))
    back = scoring.load_model(spark, str(tmp_path / "m"))
    a = scoring.score_batch(numbers, linear).select("id", "prediction", "lower").collect()
    b = scoring.score_batch(numbers, back).select("id", "prediction", "lower").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("algorithm", ["logistic_regression", "random_forest_classifier", "gradient_boosting_classifier",
                                       "neural_network_classifier"])
def test_binary_classifiers(classes, algorithm):
    model = ml.train(classes, algorithm, ["a", "b"], "y2", KEY, "classification",
                     {"n_estimators": 8, "max_depth": 3, "max_iter": 40})
    assert model.metrics["accuracy"] > 0.9
    got = scoring.score_batch(classes, model).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.49 <= got[0] <= got[1] <= 1.0


def test_multiclass_boosting(classes):
    model = ml.train(classes, "lightgbm_classifier", ["a"], "y3", KEY, "classification", {"n_estimators": 5})
    assert model.metrics["accuracy"] > 0.9
    assert {r.prediction for r in scoring.score_batch(classes, model).select("prediction").distinct().collect()} == {"low", "mid", "top"}


def test_forest_outputs(forest, classes, spark):
    probabilities = scoring.class_probabilities(classes, forest, KEY).groupBy("id").agg(F.sum("probability").alias("s"))
    assert probabilities.where("abs(s - 1) > 0.001").count() == 0
    ranked = ml.model_importance(spark, forest).collect()
    assert [r.rank for r in ranked] == [1, 2, 3] and ranked[0].feature == "a"
    explained = scoring.explain_batch(classes, forest, KEY)
    assert explained.count() == 900 and explained.where("rank = 1 and feature <> 'a'").count() < 120
    schema = {r.name: (r.type, r.options) for r in ml.feature_schema(spark, forest.stats).collect()}
    assert schema == {"a": ("numeric", None), "b": ("numeric", None), "g": ("categorical", 5)}


def test_runs_and_cards(linear, forest, spark):
    runs = ml.model_runs(spark, [linear, forest]).withColumn("is_selected", F.col("id") == "run001")
    assert runs.where("status = 'done'").count() == 2
    card = ml.model_card(runs, ml.model_importance(spark, forest), 300, 3).first()
    assert (card.algorithm, card.metric, card.limitations) == ("random_forest_classifier", "Accuracy", ["none"])
    assert ml.pick_best(runs.where("id = 'run000'")).first().metric == "R²"
    assert ml.radar_data(runs.where("id = 'run000'")).count() == 0


def test_train_many_compares(numbers, spark):
    models = ml.train_many(numbers, ["linear_regression", "random_forest_regressor", "xgboost_regressor"], ["a", "b", "g"],
                           "y", KEY, params={"n_estimators": 5, "max_depth": 3})
    table = ml.compare_models(ml.model_runs(spark, models)).collect()
    assert [r.recommended for r in table] == [True, False, False]
    assert all(m.stats.residual_std > 0 for m in models)
    with pytest.raises(ValueError):
        ml.train(numbers, "neural_network_regressor", ["a"], "y", KEY)
    with pytest.raises(ValueError):
        ml.train(numbers, "linear_regression", ["nope"], "y", KEY)


def test_retrain_takes_the_selected_run(numbers, table):
    runs = table("id string, algorithm string, status string, is_selected boolean, created_at long",
                 [("1", "linear_regression", "done", True, 1), ("2", "random_forest_regressor", "done", False, 2)])
    assert ml.retrain(numbers, runs, ["a"], "y", KEY).algorithm == "linear_regression"
    with pytest.raises(ValueError):
        ml.retrain(numbers, runs.where("status = 'failed'"), ["a"], "y", KEY)


def test_cross_validation(numbers, classes):
    folds = ml.cross_validate(numbers, "linear_regression", ["a", "b", "g"], "y", KEY, k=3).collect()
    assert len(folds) == 3 and folds[0].ci_low <= folds[0].mean <= folds[0].ci_high and folds[0].mean > 0.9
    spread = ml._fold_rows(classes, KEY, 5, "y3").groupBy("y3", "fold").count().collect()
    assert {r["count"] for r in spread} == {20}
    with pytest.raises(ValueError):
        ml.cross_validate(numbers.limit(1), "linear_regression", ["a"], "y", KEY)


def test_tuning(classes, numbers):
    model, report = ml.tune(classes, "gradient_boosting_classifier", ["a"], "y2", KEY, "classification", n_iter=2, folds=2,
                            base={"n_estimators": 2})
    row = report.first()
    assert row.tunable and model.algorithm == "gradient_boosting_classifier" and row.after > 0.5
    none, report = ml.tune(numbers, "linear_regression", ["a"], "y", KEY)
    assert none is None and report.first().tunable is False
    assert len(ml.draw_params("random_forest_regressor", 50)) == 10
    assert ml.draw_params("logistic_regression", 3) == ml.draw_params("logistic_regression", 3)


def test_metrics_by_hand(table):
    df = table("actual double, predicted double", [(1.0, 1.0), (2.0, 3.0), (3.0, 3.0), (4.0, None)])
    assert tuple(validation.regression_metrics(df).first()) == (0.5, 0.3333, 0.5774, 3)
    flat = table("actual double, predicted double", [(1.0, 1.0), (1.0, 2.0)])
    assert validation.regression_metrics(flat).first().r2 is None
    labels = table("actual string, predicted string", [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")])
    got = validation.classification_metrics(labels).first()
    assert (got.accuracy, got.recall, got.precision, got.f1) == (0.75, 1.0, 0.6667, 0.8)
    three = labels.union(table("a string, p string", [("c", "a")]))
    assert validation.classification_metrics(three).first().recall == 0.6
    assert validation.confusion(three).count() == 4
    matrix = {r.actual: (r.a, r.b, r.c) for r in validation.confusion_matrix(three).collect()}
    assert matrix == {"a": (1, 1, 0), "b": (0, 2, 0), "c": (1, 0, 0)}
    guess = table("actual string, predicted string", [("a", "z")])
    assert {r.actual: r.z for r in validation.confusion_matrix(guess).collect()} == {"a": 1, "z": 0}
    assert validation.confusion_summary(three).first().worst_class == "c"


def test_segments(table):
    rows = [("big", float(i), float(i)) for i in range(12)] + [("bad", float(i), -9.0 * i) for i in range(5)]
    df = table("g string, actual double, predicted double", rows + [("one", 1.0, 1.0), (None, 2.0, 2.0)])
    got = {r.segment: r for r in validation.segment_performance(df, "g").collect()}
    assert (got["big"].metric, got["big"].status, got["big"].is_best) == (1.0, "strong", True)
    assert (got["bad"].metric, got["bad"].status, got["bad"].low_sample, got["bad"].gap) == (-1.0, "poor", True, 2.0)
    assert got["one"].status == "insufficient_data" and "nan" in got
    flat = table("g string, actual double, predicted double", [("f", 1.0, 1.0), ("f", 1.0, 2.0)])
    assert validation.segment_performance(flat, "g").first().metric is None
    wide = table("g string", [(f"v{i}",) for i in range(60)])
    with pytest.raises(ValueError):
        validation.checked_segment_performance(wide, df, "g")


def test_errors_and_residuals(table):
    df = table("id long, actual double, predicted double", [(i, float(i), float(i) + (i % 4)) for i in range(1, 41)])
    top = validation.prediction_errors(df, KEY, n=3).collect()
    assert [(r.rank, r.id, r.abs_error) for r in top] == [(1, 3, 3.0), (2, 7, 3.0), (3, 11, 3.0)]
    assert validation.prediction_errors(df, KEY, n=900).count() == 40
    assert validation.prediction_errors(df.limit(0), KEY, "classification").count() == 0
    summary = validation.residual_summary(df).first()
    assert (summary.mae, summary.bias, summary.bias_label) == (1.5, -1.5, "over-prediction")
    assert validation.residual_sample(df, KEY, 10).count() == 10
