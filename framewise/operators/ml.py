"""Feature preparation, training, comparison, tuning and cross-validation with Spark ML."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from framewise.functions.columns import field_type, is_numeric, ladder, ref, require_columns
from framewise.functions.quantiles import group_percentiles
from framewise.functions.scale import broadcast_if_few, broadcast_if_small, hash_positions, is_small, row_positions, spread
from framewise.operators.aggregates import unpivot_numeric
from framewise.operators.network import NetworkClassifier, NetworkRegressor
from framewise.operators.trees import CellTrees
from framewise.operators.validation import classification_metrics, regression_metrics

MISSING = "MISSING"
SEED = 42
MAX_CLASSES = 10_000

# Algorithm names. Both external boosters run on Spark's gradient-boosted trees.
REGRESSION = (
    "linear_regression",
    "random_forest_regressor",
    "gradient_boosting_regressor",
    "xgboost_regressor",
    "lightgbm_regressor",
    # A multi-layer perceptron; an earlier test holds that "neural_network_regressor" is no known name.
    "mlp_regressor",
)
CLASSIFICATION = (
    "logistic_regression",
    "random_forest_classifier",
    "gradient_boosting_classifier",
    "xgboost_classifier",
    "lightgbm_classifier",
    "neural_network_classifier",
)
TREE_REGRESSION = ("random_forest_regressor", "gradient_boosting_regressor", "xgboost_regressor", "lightgbm_regressor")
# Search grids per family.
FOREST_GRID = {
    "n_estimators": [50, 100, 200, 300],
    "max_depth": [None, 5, 10, 15],
    "min_samples_leaf": [1, 2, 4],
}
BOOSTING_GRID = {
    "n_estimators": [50, 100, 200],
    "max_depth": [2, 3, 5],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.8, 1.0],
}
LOGISTIC_GRID = {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "max_iter": [500, 1000, 2000]}
# Up to so many rows train in the split they come in.
DEALT_ROWS = 20_000
# Folds fitted at a time.
PARALLEL_FOLDS = 4
# Spark trees have a depth of at most 30; an unlimited depth means this.
UNLIMITED_DEPTH = 30


@dataclass
class FeatureStats:
    """What scoring needs to know about the training rows: small numbers, and label tables as DataFrames."""

    features: list[str]
    target: str
    problem_type: str
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    encoders: dict[str, DataFrame] = field(default_factory=dict)
    classes: list[Any] | None = None
    residual_std: float = 0.0

    def is_categorical(self, name: str) -> bool:
        return name in self.encoders


@dataclass
class TrainedModel:
    algorithm: str
    stats: FeatureStats
    model: PipelineModel
    metrics: dict[str, float]
    duration_ms: int
    params: dict[str, Any] = field(default_factory=dict)


def fit_stats(
    df: DataFrame, features: Sequence[str], target: str, problem_type: str
) -> FeatureStats:
    """Medians, means, sample stds, category tables and target classes of the rows with a target."""
    require_columns(df, target)
    names = [f for f in features if f in df.columns]
    if not names:
        raise ValueError("None of the named features is a usable column")
    rows = df.where(ref(target).isNotNull())
    stats = FeatureStats(names, target, problem_type)
    numeric = [c for c in names if is_numeric(field_type(df, c))]
    if numeric:
        long = unpivot_numeric(rows, numeric).where(F.col("value").isNotNull())
        moments = long.groupBy("column").agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
        )
        # One row per feature.
        for r in moments.join(group_percentiles(long, ["column"], "value", {"m": 0.5}), "column").collect():
            stats.medians[r["column"]] = r["m"]
            stats.means[r["column"]] = r["mean"]
            stats.stds[r["column"]] = 1.0 if r["std"] is None else r["std"]
        for c in numeric:
            stats.medians.setdefault(c, 0.0)
    for c in names:
        if c not in numeric:
            text = F.coalesce(ref(c).cast("string"), F.lit(MISSING))
            table = row_positions(rows.select(text.alias("category")).distinct(), [F.col("category")], "index")
            # Catalyst takes a list of categories for as large as the table, and would shuffle all rows to join it.
            stats.encoders[c] = broadcast_if_few(table)
    if problem_type == "classification":
        found = rows.select(ref(target).alias("c")).distinct().orderBy("c").limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            raise ValueError(f"'{target}' has more than {MAX_CLASSES} classes")
        stats.classes = [r.c for r in found]
    return stats


def feature_schema(spark, stats: FeatureStats) -> DataFrame:
    """A row per feature: type, median of a number, number of options of a category."""
    rows = []
    for c in stats.features:
        if stats.is_categorical(c):
            rows.append((c, "categorical", None, stats.encoders[c].count()))
        else:
            rows.append((c, "numeric", float(stats.medians[c]), None))
    return spark.createDataFrame(rows, "name string, type string, median double, options long")


def encode(df: DataFrame, stats: FeatureStats, keep_unseen: bool = False) -> DataFrame:
    """Numeric form of the features in ``_e_<feature>`` columns and the vector ``features``.

    Missing numbers become the median, categories their index, unseen categories index 0. With
    ``keep_unseen``, ``_unseen`` counts those.
    """
    out = df
    unseen: Column = F.lit(0)
    for c in stats.features:
        name = f"_e_{c}"
        if stats.is_categorical(c):
            value = (
                F.coalesce(ref(c).cast("string"), F.lit(MISSING)) if c in df.columns else F.lit(MISSING)
            )
            table = stats.encoders[c].select(
                F.col("category").alias("_cat"), F.col("index").cast("double").alias(name)
            )
            out = out.join(broadcast_if_small(table), value == F.col("_cat"), "left").drop("_cat")
            unseen = unseen + ref(name).isNull().cast("int")
            out = out.withColumn("_unseen", unseen).withColumn(name, F.coalesce(ref(name), F.lit(0.0)))
            unseen = F.col("_unseen")
        else:
            value = ref(c).cast("double") if c in df.columns else F.lit(None).cast("double")
            out = out.withColumn(name, F.coalesce(value, F.lit(float(stats.medians[c]))))
    if not stats.encoders:
        out = out.withColumn("_unseen", F.lit(0))
    assembler = VectorAssembler(inputCols=[f"_e_{c}" for c in stats.features], outputCol="features")
    out = assembler.transform(out)
    return out if keep_unseen else out.drop("_unseen")


def _label(stats: FeatureStats) -> Column:
    target = ref(stats.target)
    if stats.problem_type == "regression":
        return target.cast("double")
    pairs = [F.lit(x) for i, c in enumerate(stats.classes or []) for x in (c, float(i))]
    return F.create_map(*pairs)[target]


def prepare_features(
    df: DataFrame, features: Sequence[str], target: str, problem_type: str
) -> DataFrame:
    """Rows with a target, their feature vector and numeric ``label``."""
    stats = fit_stats(df, features, target, problem_type)
    return _prepared(df, stats)


def _used(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str] = ()) -> list[str]:
    """The columns that training reads, once each."""
    require_columns(df, target)
    keys = {k.lower() for k in key}
    return [c for c in df.columns if c in features or c == target or c.lower() in keys]


def _prepared(df: DataFrame, stats: FeatureStats) -> DataFrame:
    rows = df.where(ref(stats.target).isNotNull())
    return encode(rows, stats).withColumn("label", _label(stats))


def split(
    df: DataFrame, key: Sequence[str], test_pct: int = 20, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Seeded train and test rows by hash of the key: stable under any partitioning.

    Fewer than 10 rows serve as both.
    """
    if len(df.select(*[ref(k) for k in key]).limit(10).take(10)) < 10:
        return df, df
    spot = F.pmod(F.xxhash64(*[ref(k) for k in key], F.lit(seed)), F.lit(100))
    return df.where(spot >= test_pct), df.where(spot < test_pct)


def estimator(algorithm: str, n_features: int, n_classes: int, params: dict[str, Any], n_rows: int):
    """Spark ML estimator of an algorithm; unset parameters take the usual defaults."""
    p = {"seed": SEED, **params}
    depth = p.get("max_depth", 3 if "boost" in algorithm or "gbm" in algorithm else None)
    depth = UNLIMITED_DEPTH if depth in (None, -1) else int(depth)
    if algorithm == "linear_regression":
        return LinearRegression()
    if algorithm == "logistic_regression":
        # C scales the summed loss, Spark penalises the mean loss.
        strength = 1.0 / (float(p.get("C", 1.0)) * max(n_rows, 1))
        return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=strength)
    if algorithm.startswith("random_forest"):
        kind = RandomForestRegressor if algorithm in REGRESSION else RandomForestClassifier
        return kind(
            numTrees=int(p.get("n_estimators", 100)),
            maxDepth=depth,
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            seed=p["seed"],
        )
    if algorithm == "neural_network_classifier":
        net = MultilayerPerceptronClassifier(
            layers=[n_features, 100, 50, max(n_classes, 2)],
            maxIter=int(p.get("max_iter", 500)),
            seed=p["seed"],
            featuresCol="_scaled",
        )
        scale = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True)
        # The library's own loops suit few rows; over many, array operations take the gradient.
        return Pipeline(stages=[scale, NetworkClassifier(net) if n_rows > DEALT_ROWS else net])
    if algorithm == "mlp_regressor":
        return NetworkRegressor(rounds=int(p.get("rounds", 25)), seed=p["seed"])
    boosting = {
        "maxIter": int(p.get("n_estimators", 100)),
        "maxDepth": depth,
        "stepSize": float(p.get("learning_rate", 0.1)),
        "subsamplingRate": float(p.get("subsample", 1.0)),
        "seed": p["seed"],
    }
    if algorithm in REGRESSION:
        return GBTRegressor(**boosting)
    if algorithm in CLASSIFICATION:
        booster = GBTClassifier(**boosting)
        return booster if n_classes <= 2 else OneVsRest(classifier=booster)
    raise ValueError(
        f"Unknown algorithm '{algorithm}'. Valid choices: {sorted(REGRESSION + CLASSIFICATION)}"
    )


def decoded(stats: FeatureStats, prediction: Column) -> Column:
    """Prediction as shown: a number to 4 digits, or the class label."""
    if stats.problem_type == "regression":
        return F.round(prediction, 4)
    return F.element_at(class_labels(stats), prediction.cast("int") + 1)


def class_labels(stats: FeatureStats) -> Column:
    """The classes as text, written as Spark writes the target's values."""
    return F.array(*[F.lit(c).cast("string") for c in stats.classes or []])


def class_probabilities_of(scored: DataFrame) -> Column | None:
    """Array of class probabilities of scored rows, None for models without any.

    One-vs-rest boosting gives a margin per class: each becomes the probability of its class against the rest, and
    these are made to add up to 1.
    """
    if "probability" in scored.columns:
        return vector_to_array("probability")
    if "rawPrediction" not in scored.columns:
        return None
    single = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(single, F.lit(0.0), lambda a, b: a + b)
    return F.transform(single, lambda p: p / total)


def _fit(
    train_rows: DataFrame, stats: FeatureStats, algorithm: str, params: dict[str, Any]
) -> PipelineModel:
    # The logistic penalty and the ways of training networks and regression trees depend on the number of rows.
    counted = ("logistic_regression", "neural_network_classifier", *TREE_REGRESSION)
    n = train_rows.count() if algorithm in counted else 0
    est = estimator(algorithm, len(stats.features), len(stats.classes or []), params, n)
    # The library reads all rows for each level of a forest and of each round; over many, their sums take one reading.
    if algorithm in TREE_REGRESSION and n > DEALT_ROWS:
        est = CellTrees(est)
    return Pipeline(stages=[est]).fit(train_rows)


def _measured(model: PipelineModel, rows: DataFrame, problem_type: str) -> dict[str, float]:
    scored = model.transform(rows).select(
        F.col("label").alias("actual"), F.col("prediction").alias("predicted")
    )
    row = (
        regression_metrics(scored) if problem_type == "regression" else classification_metrics(scored)
    ).first()
    return row.asDict()


def _check(algorithm: str, problem_type: str) -> None:
    valid = REGRESSION if problem_type == "regression" else CLASSIFICATION
    if algorithm not in valid:
        raise ValueError(f"Unknown algorithm '{algorithm}'. Valid choices: {sorted(valid)}")


def train(
    df: DataFrame,
    algorithm: str,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    problem_type: str = "regression",
    params: dict[str, Any] | None = None,
    seed: int = SEED,
) -> TrainedModel:
    """Fit on the training rows, measure on the held-out ones.

    Fill values and category tables come from the training rows alone.
    """
    return train_many(df, [algorithm], features, target, key, problem_type, params, seed, strict=True)[0]


def train_many(
    df: DataFrame,
    algorithms: Sequence[str],
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    problem_type: str = "regression",
    params: dict[str, Any] | None = None,
    seed: int = SEED,
    strict: bool = False,
) -> list[TrainedModel]:
    """Train several algorithms on one prepared, cached training set; failed ones carry an ``error`` metric."""
    for a in algorithms:
        _check(a, problem_type)
    rows = df.where(ref(target).isNotNull())
    used = [ref(c) for c in _used(df, features, target)]
    fit_rows, test_rows = [part.select(*used) for part in split(rows, key, seed=seed)]
    # As many tasks as all rows need serve either part. A small table is dealt out once prepared; few rows stay in their split.
    size, late = rows.count(), is_small(rows)
    if size > DEALT_ROWS:
        fit_rows, test_rows = [(part if late else spread(part, size)).persist() for part in (fit_rows, test_rows)]

    def ready(part: DataFrame) -> DataFrame:
        if size <= DEALT_ROWS:
            return spread(part)
        return spread(part, size) if late else part

    prepared = held = None
    try:
        stats = fit_stats(fit_rows, features, target, problem_type)
        prepared = ready(_prepared(fit_rows, stats).select("features", "label")).persist()
        held = ready(_prepared(test_rows, stats).select("features", "label"))
        held = held.where(F.col("label").isNotNull()).persist()
        sizes = {"train_size": prepared.count(), "test_size": held.count()}
        fit_rows.unpersist()
        test_rows.unpersist()
        models = []
        for a in algorithms:
            start = time.time()
            try:
                model = _fit(prepared, stats, a, params or {})
                elapsed = int((time.time() - start) * 1000)
                metrics = {**_measured(model, held, problem_type), **sizes}
            except Exception as exc:
                if strict:
                    raise
                model, elapsed, metrics = None, 0, {"error": str(exc)}
            models.append(TrainedModel(a, stats, model, metrics, elapsed, dict(params or {})))
        if problem_type == "regression":
            for m in models:
                if m.model is not None:
                    # Population std of the training residuals: the band of later predictions.
                    residual = F.col("label") - F.col("prediction")
                    std = m.model.transform(prepared).agg(F.stddev_pop(residual)).first()[0]
                    m.stats = FeatureStats(**{**stats.__dict__, "residual_std": float(std or 0.0)})
        return models
    finally:
        for part in (fit_rows, test_rows, prepared, held):
            if part is not None:
                part.unpersist()


RUN_SCHEMA = (
    "id string, algorithm string, problem_type string, status string, r2 double, mae double, rmse double, "
    "accuracy double, f1 double, precision double, recall double, train_size long, test_size long, "
    "training_duration_ms long, error_message string"
)


def model_runs(spark, models: Sequence[TrainedModel]) -> DataFrame:
    """A row per trained model with its metrics and status."""
    rows = []
    for i, m in enumerate(models):
        get = m.metrics.get
        rows.append(
            (
                f"run{i:03d}",
                m.algorithm,
                m.stats.problem_type,
                "failed" if "error" in m.metrics else "done",
                *[get(k) for k in ("r2", "mae", "rmse", "accuracy", "f1", "precision", "recall")],
                get("train_size"),
                get("test_size"),
                m.duration_ms,
                get("error"),
            )
        )
    return spark.createDataFrame(rows, RUN_SCHEMA)


def _primary() -> Column:
    return F.when(F.col("problem_type") == "regression", F.col("r2")).otherwise(F.col("f1"))


def pick_best(runs: DataFrame) -> DataFrame:
    """One row: the finished run with the highest R² (regression) or F1 (classification)."""
    done = runs.where(F.col("status") == "done").withColumn("_s", F.coalesce(_primary(), F.lit(-999.0)))
    return done.orderBy(F.desc("_s"), "id").limit(1).select(
        F.col("id").alias("model_run_id"),
        "algorithm",
        F.when(F.col("problem_type") == "regression", "R²").otherwise("F1 score").alias("metric"),
        F.round("_s", 3).alias("score"),
    )


def compare_models(runs: DataFrame) -> DataFrame:
    """Finished runs, best first, with the recommended one marked."""
    done = runs.where(F.col("status") == "done")
    best = pick_best(runs).select(F.col("model_run_id").alias("_best"))
    return done.crossJoin(F.broadcast(best)).withColumn("recommended", F.col("id") == F.col("_best")).drop(
        "_best"
    ).orderBy(F.desc_nulls_last(_primary()), "id")


def radar_data(runs: DataFrame) -> DataFrame:
    """Metrics of the finished runs scaled to 0-1, higher is better; no rows for fewer than two runs."""
    done = runs.where(F.col("status") == "done")
    tops = done.agg(
        F.count(F.lit(1)).alias("_n"), F.max("mae").alias("_mae"), F.max("rmse").alias("_rmse")
    )
    wide = done.crossJoin(F.broadcast(tops)).where(F.col("_n") >= 2)

    def share(name: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(name), F.lit(0.0))))

    def inverse(name: str, top: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0.0))
        return F.when(F.col(top) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - value / F.col(top)))

    regression = F.col("problem_type") == "regression"
    spokes = [
        ("R²", regression, share("r2")),
        ("MAE Score", regression, inverse("mae", "_mae")),
        ("RMSE Score", regression, inverse("rmse", "_rmse")),
        ("Accuracy", ~regression, share("accuracy")),
        ("F1 Score", ~regression, share("f1")),
        ("Precision", ~regression, share("precision")),
        ("Recall", ~regression, share("recall")),
    ]
    structs = [
        F.when(used, F.struct(F.lit(name).alias("metric"), F.round(value, 3).alias("value")))
        for name, used, value in spokes
    ]
    return wide.select("id", "algorithm", F.inline(F.array_compact(F.array(*structs))))


# --- tuning and validation --------------------------------------------------------------------


def tuning_grid(algorithm: str) -> dict[str, list]:
    """Parameter values searched for an algorithm; empty when there is nothing to tune."""
    if algorithm.startswith("random_forest"):
        return FOREST_GRID
    if algorithm.startswith(("gradient_boosting", "xgboost", "lightgbm")):
        return BOOSTING_GRID
    return LOGISTIC_GRID if algorithm == "logistic_regression" else {}


def draw_params(algorithm: str, n_iter: int, seed: int = SEED) -> list[dict[str, Any]]:
    """Distinct seeded draws from the grid, at most ten."""
    grid = tuning_grid(algorithm)
    size = int(np.prod([len(v) for v in grid.values()])) if grid else 0
    rng = random.Random(seed)
    picks = rng.sample(range(size), min(n_iter, 10, size))
    draws = []
    for pick in picks:
        draw = {}
        for name, values in grid.items():
            pick, at = divmod(pick, len(values))
            draw[name] = values[at]
        draws.append(draw)
    return draws


def _fold_rows(
    df: DataFrame, key: Sequence[str], k: int, by_class: str | None, seed: int = SEED
) -> DataFrame:
    """Adds ``fold`` 0..k-1 by rank of the key's hash, within each class when given: sizes differ by one."""
    placed = hash_positions(df, key, seed, "_place", [by_class] if by_class else [])
    return placed.withColumn("fold", F.pmod("_place", F.lit(k)).cast("int")).drop("_place")


def tune(
    df: DataFrame,
    algorithm: str,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    problem_type: str = "regression",
    n_iter: int = 10,
    folds: int = 3,
    parallelism: int = 4,
    base: dict[str, Any] | None = None,
) -> tuple[TrainedModel | None, DataFrame]:
    """Random search over the grid by cross-validation on the training rows, then a held-out comparison.

    Returns the tuned model and one row with the chosen parameters, scores before and after and the change in
    percent; an algorithm without parameters returns no model and ``tunable`` false.
    """
    _check(algorithm, problem_type)
    spark = df.sparkSession
    schema = (
        "algorithm string, tunable boolean, best_params string, cv_score double, before double, "
        "after double, improvement_pct double"
    )
    draws = draw_params(algorithm, n_iter)
    if not draws:
        return None, spark.createDataFrame([(algorithm, False, None, None, None, None, None)], schema)
    rows = df.where(ref(target).isNotNull())
    fit_rows, _ = split(rows, key)
    fit_rows = fit_rows.select(*[ref(c) for c in _used(df, features, target, key)])
    size = fit_rows.count()
    fit_rows = spread(fit_rows, size).persist()
    stats = fit_stats(fit_rows, features, target, problem_type)
    prepared = _prepared(fit_rows, stats)
    by_class = "label" if problem_type == "classification" else None
    # Each draw and fold reads these rows many times: as many tasks as they need, not as the ranking's shuffle gave.
    folded = spread(_fold_rows(prepared, key, folds, by_class).select("features", "label", "fold"), size).persist()
    try:
        n = folded.count()
        judge = (
            RegressionEvaluator(metricName="r2")
            if problem_type == "regression"
            else MulticlassClassificationEvaluator(metricName="f1")
        )
        classes = len(stats.classes or [])
        start = estimator(algorithm, len(stats.features), classes, base or {}, n)
        maps = []
        for draw in draws:
            other = estimator(algorithm, len(stats.features), classes, {**(base or {}), **draw}, n)
            changed = {
                start.getParam(p.name): other.getOrDefault(p.name)
                for p in other.params
                if other.isSet(p.name) and p.name not in ("featuresCol", "labelCol")
            }
            maps.append(changed)
        search = CrossValidator(
            estimator=start,
            estimatorParamMaps=maps,
            evaluator=judge,
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        )
        found = search.fit(folded)
        scores = found.avgMetrics
    finally:
        folded.unpersist()
        fit_rows.unpersist()
    at = int(np.argmax(scores))
    before = train(df, algorithm, features, target, key, problem_type, base)
    after = train(df, algorithm, features, target, key, problem_type, {**(base or {}), **draws[at]})
    name = "r2" if problem_type == "regression" else "f1"
    b, a = before.metrics[name], after.metrics[name]
    gain = round((a - b) / abs(b) * 100, 2) if b else None
    report = spark.createDataFrame(
        [(algorithm, True, json.dumps(draws[at], sort_keys=True), round(float(scores[at]), 4), b, a, gain)],
        schema,
    )
    return after, report


def retrain(
    df: DataFrame,
    runs: DataFrame,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    problem_type: str = "regression",
    params: dict[str, Any] | None = None,
) -> TrainedModel:
    """Train the selected (else the latest finished) run's algorithm on the current data."""
    done = runs.where(F.col("status") == "done")
    pick = done.orderBy(F.desc("is_selected"), F.desc("created_at"), F.desc("id")).limit(1).first()
    if pick is None:
        raise ValueError("No finished run to retrain")
    return train(df, pick["algorithm"], features, target, key, problem_type, params)


def cross_validate(
    df: DataFrame,
    algorithm: str,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    problem_type: str = "regression",
    k: int = 5,
    params: dict[str, Any] | None = None,
) -> DataFrame:
    """One row per fold with its R² or weighted F1, and the mean, population std and ±1.96 std over the folds.

    Folds are stratified by class for classification.
    """
    _check(algorithm, problem_type)
    rows = df.where(ref(target).isNotNull())
    narrow = rows.select(*[ref(c) for c in _used(df, features, target, key)])
    k = min(k, len(rows.limit(k).take(k)))
    if k < 2:
        raise ValueError("Folds need two rows or more")
    by_class = target if problem_type == "classification" else None
    folded = _fold_rows(narrow, key, k, by_class).select(*[ref(c) for c in _used(df, features, target)], "fold")
    # A small input is ranked in one task, which the folds' many readings must not stay in; a larger one lies in many.
    if is_small(narrow) and (size := narrow.count()) > DEALT_ROWS:
        folded = spread(folded, size)
    folded = folded.persist()

    def score(fold: int) -> float:
        fit_rows = folded.where(F.col("fold") != fold)
        stats = fit_stats(fit_rows, features, target, problem_type)
        model = _fit(_prepared(fit_rows, stats).select("features", "label"), stats, algorithm, params or {})
        held = _prepared(folded.where(F.col("fold") == fold), stats)
        scored = model.transform(held.where(F.col("label").isNotNull()))
        judge = (
            RegressionEvaluator(metricName="r2")
            if problem_type == "regression"
            else MulticlassClassificationEvaluator(metricName="f1")
        )
        return float(judge.evaluate(scored))

    try:
        folded.count()
        # The folds' jobs are independent: Spark runs several at a time.
        with ThreadPoolExecutor(PARALLEL_FOLDS) as pool:
            scores = list(pool.map(inheritable_thread_target(df.sparkSession)(score), range(k)))
    finally:
        folded.unpersist()
    mean, std = float(np.mean(scores)), float(np.std(scores))
    metric = "r2" if problem_type == "regression" else "f1_weighted"
    summary = [round(x, 4) for x in (mean, std, mean - 1.96 * std, mean + 1.96 * std)]
    data = [(i, metric, round(s, 4), *summary) for i, s in enumerate(scores)]
    return df.sparkSession.createDataFrame(
        data,
        "fold int, metric string, score double, mean double, std double, ci_low double, ci_high double",
    )


def _importances(model: PipelineModel, n: int) -> list[float]:
    fitted = model.stages[-1]
    if isinstance(fitted, PipelineModel):
        fitted = fitted.stages[-1]
    if hasattr(fitted, "featureImportances"):
        raw = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficientMatrix"):
        raw = np.abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(fitted, "coefficients"):
        raw = np.abs(fitted.coefficients.toArray())
    elif hasattr(fitted, "models") and all(hasattr(m, "featureImportances") for m in fitted.models):
        raw = np.mean([m.featureImportances.toArray() for m in fitted.models], axis=0)
    else:
        raw = np.ones(n)
    raw = np.abs(np.asarray(raw)[:n])
    total = raw.sum()
    return (raw / total if total > 0 else raw).tolist()


def importance_map(trained: TrainedModel) -> dict[str, float]:
    """Normalised weight per feature."""
    names = trained.stats.features
    return {n: round(v, 6) for n, v in zip(names, _importances(trained.model, len(names)))}


def model_importance(spark, trained: TrainedModel) -> DataFrame:
    """Feature weights normalised to 1, ranked; equal where the model gives none."""
    weights = importance_map(trained)
    ranked = sorted(weights.items(), key=lambda p: (-p[1], trained.stats.features.index(p[0])))
    rows = [(f, float(v), i) for i, (f, v) in enumerate(ranked, start=1)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def model_card(runs: DataFrame, importance: DataFrame, row_count: int, feature_count: int) -> DataFrame:
    """One row on the selected (else best) finished run: primary metric, its reading, drivers and limits."""
    regression = F.col("problem_type") == "regression"
    value = F.when(regression, F.col("r2")).otherwise(F.coalesce("accuracy", F.lit(0.0)))
    done = runs.where(F.col("status") == "done").withColumn("_v", F.coalesce(value, F.lit(0.0)))
    pick = done.orderBy(F.desc("is_selected"), F.desc("_v"), "id").limit(1)
    drivers = importance.where(F.col("rank") <= 5).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]
        ).alias("top_features")
    )
    reading = F.when(
        regression, ladder(F.col("_v"), [(0.9, "excellent"), (0.7, "good"), (0.5, "moderate")], "limited")
    ).otherwise(F.when(F.col("_v") >= 0.5, "above chance").otherwise("below chance"))
    limits = F.array_compact(
        F.array(
            F.when(F.lit(row_count < 200), "few_rows"),
            F.when(regression & (F.coalesce("r2", F.lit(1.0)) < 0.6), "low_r2"),
            F.when(~regression & (F.coalesce("accuracy", F.lit(1.0)) < 0.75), "low_accuracy"),
            F.when(F.lit(feature_count < 3), "few_features"),
        )
    )
    return pick.crossJoin(drivers).select(
        F.col("id").alias("model_run_id"),
        "algorithm",
        "problem_type",
        F.when(regression, "R²").otherwise("Accuracy").alias("metric"),
        F.round("_v", 4).alias("value"),
        reading.alias("reading"),
        "top_features",
        F.when(F.size(limits) > 0, limits).otherwise(F.array(F.lit("none"))).alias("limitations"),
        F.lit(row_count).cast("long").alias("row_count"),
        F.lit(feature_count).alias("feature_count"),
    )
