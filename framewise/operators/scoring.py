"""Scoring with a trained model: batches, what-if overrides, scenarios and side-by-side models."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.columns import ref
from framewise.functions.scale import spread
from framewise.operators.ml import (
    FeatureStats,
    TrainedModel,
    class_labels,
    class_probabilities_of,
    decoded,
    encode,
    importance_map,
)
from framewise.operators.validation import explain_rows

MAX_SCENARIOS = 10
# Scores that cost a few sums a row; others are dealt over all cores.
CHEAP = ("linear_regression", "logistic_regression")


def _dealt(df: DataFrame, trained: TrainedModel) -> DataFrame:
    """The rows for scoring: a file may come in one split, too long for one task where each row runs down many trees."""
    return df if trained.algorithm in CHEAP else spread(df, df.count())


def score_batch(df: DataFrame, trained: TrainedModel) -> DataFrame:
    """All columns plus prediction, confidence (classification), 95 % band (regression) and unseen count."""
    stats = trained.stats
    names = [c for c in df.columns if c not in ("prediction", "confidence", "lower", "upper", "unseen")]
    scored = trained.model.transform(encode(_dealt(df, trained), stats, keep_unseen=True))
    shown = decoded(stats, F.col("prediction"))
    if stats.problem_type == "regression":
        half = 1.96 * stats.residual_std
        banded = stats.residual_std > 0
        lower = F.round(shown - half, 4) if banded else F.lit(None).cast("double")
        upper = F.round(shown + half, 4) if banded else F.lit(None).cast("double")
        confidence = F.lit(None).cast("double")
    else:
        lower = upper = F.lit(None).cast("double")
        shares = class_probabilities_of(scored)
        best = F.lit(None) if shares is None else F.round(F.array_max(shares), 4)
        confidence = best.cast("double")
    return scored.select(
        *[ref(c) for c in names],
        shown.alias("prediction"),
        confidence.alias("confidence"),
        lower.alias("lower"),
        upper.alias("upper"),
        F.col("_unseen").alias("unseen"),
    )


def class_probabilities(df: DataFrame, trained: TrainedModel, key: Sequence[str]) -> DataFrame:
    """Long form (key, class, probability) of a probabilistic classifier."""
    scored = trained.model.transform(encode(_dealt(df, trained), trained.stats))
    shares = class_probabilities_of(scored)
    if shares is None:
        raise ValueError(f"'{trained.algorithm}' gives no class probabilities")
    pairs = F.arrays_zip(class_labels(trained.stats).alias("class"), shares.alias("probability"))
    long = scored.select(*[ref(k) for k in key], F.inline(pairs))
    return long.withColumn("probability", F.round("probability", 4))


def _change(df: DataFrame, numeric: bool) -> DataFrame:
    """Adds delta, percent_change (of |base|) and direction to base and new predictions."""
    if not numeric:
        same = F.col("prediction") == F.col("base_prediction")
        return df.withColumns(
            {
                "delta": F.lit(None).cast("double"),
                "percent_change": F.lit(None).cast("double"),
                "direction": F.when(same, "same").otherwise("changed"),
            }
        )
    delta = F.round(F.col("prediction") - F.col("base_prediction"), 4)
    base = F.col("base_prediction")
    return df.withColumn("delta", delta).withColumns(
        {
            "percent_change": F.when(base != 0, F.round(F.col("delta") / F.abs(base) * 100, 2)),
            "direction": F.when(F.col("delta") > 0, "increase")
            .when(F.col("delta") < 0, "decrease")
            .otherwise("no change"),
        }
    )


def scenarios(
    df: DataFrame,
    trained: TrainedModel,
    key: Sequence[str],
    cases: Sequence[tuple[str, dict[str, Any]]],
) -> DataFrame:
    """Each row under 1-10 labelled override sets against its base prediction, best and worst marked.

    The row as it is and each case are scored one after another on the same row, so rows are never grouped and rows with
    equal keys stay apart.
    """
    if not cases:
        raise ValueError("Give one scenario or more")
    if len(cases) > MAX_SCENARIOS:
        raise ValueError(f"A call takes {MAX_SCENARIOS} scenarios, not more")
    for _, overrides in cases:
        unknown = [c for c in overrides if c not in df.columns]
        if unknown:
            raise ValueError(f"Columns not found: {', '.join(unknown)}")
    touched = list(dict.fromkeys(c for _, overrides in cases for c in overrides))
    rows = df.withColumns({**{f"_was_{c}": ref(c) for c in touched}, **{f"_key_{k}": ref(k) for k in key}})
    for i, (_, overrides) in enumerate([("", {}), *cases]):
        values = {c: F.lit(overrides[c]).cast(df.schema[c].dataType) if c in overrides else ref(f"_was_{c}") for c in touched}
        rows = score_batch(rows.withColumns(values), trained).withColumnRenamed("prediction", f"_p{i}")
        rows = rows.drop("confidence", "lower", "upper", "unseen")
    numeric = trained.stats.problem_type == "regression"
    made = [F.struct(F.lit(label).alias("scenario"), F.col(f"_p{i}").alias("prediction")) for i, (label, _) in enumerate(cases, 1)]
    deltas = [F.round(F.col(f"_p{i}") - F.col("_p0"), 4) for i in range(1, len(cases) + 1)] if numeric else []
    rows = rows.select(
        *[ref(f"_key_{k}").alias(k) for k in key],
        F.col("_p0").alias("base_prediction"),
        F.array(*made).alias("_cases"),
        *([F.array_max(F.array(*deltas)).alias("_best"), F.array_min(F.array(*deltas)).alias("_worst")] if numeric else []),
    )
    kept = [c for c in rows.columns if c != "_cases"]
    result = _change(rows.select(*[ref(c) for c in kept], F.inline("_cases")), numeric)
    if not numeric:
        return result.withColumns(
            {name: F.lit(None).cast("boolean") for name in ("is_best", "is_worst")}
        )
    marks = {"is_best": F.col("delta") == F.col("_best"), "is_worst": F.col("delta") == F.col("_worst")}
    return result.withColumns(marks).drop("_best", "_worst")


def what_if(
    df: DataFrame, overrides: dict[str, Any], trained: TrainedModel, key: Sequence[str]
) -> DataFrame:
    """Each row's prediction before and after the overrides, with the change."""
    result = scenarios(df, trained, key, [("what_if", overrides)])
    return result.drop("scenario", "is_best", "is_worst").withColumnRenamed(
        "prediction", "modified_prediction"
    ).withColumnRenamed("base_prediction", "original_prediction")


def compare_deployments(
    df: DataFrame, models: dict[str, TrainedModel], key: Sequence[str]
) -> DataFrame:
    """The same rows through 2-4 models, one output row per input row and model."""
    if not 2 <= len(models) <= 4:
        raise ValueError("Two to four models can be compared at once")
    parts = []
    for name, trained in models.items():
        scored = score_batch(df, trained).select(
            *[ref(k) for k in key],
            F.lit(name).alias("deployment_id"),
            F.lit(trained.algorithm).alias("algorithm"),
            F.col("prediction").cast("string").alias("prediction"),
            "confidence",
            "lower",
            "upper",
        )
        parts.append(scored)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def explain_batch(df: DataFrame, trained: TrainedModel, key: Sequence[str]) -> DataFrame:
    """Ranked feature contributions of each row, from importances and training statistics."""
    stats = trained.stats
    encoded = encode(df, stats).select(
        *[ref(k).alias(f"_k_{k}") for k in key], *[ref(f"_e_{c}").alias(c) for c in stats.features]
    )
    long = explain_rows(
        encoded, [f"_k_{k}" for k in key], importance_map(trained), stats.means, stats.stds
    )
    for k in key:
        long = long.withColumnRenamed(f"_k_{k}", k)
    return long


def save_model(trained: TrainedModel, path: str) -> None:
    """Write the fitted pipeline, its category tables and its statistics under a new folder."""
    base = path.rstrip("/")
    trained.model.write().save(f"{base}/model")
    s = trained.stats
    for i, (name, table) in enumerate(s.encoders.items()):
        table.write.mode("errorifexists").parquet(f"{base}/encoder={i}")
    facts = {
        "algorithm": trained.algorithm,
        "metrics": trained.metrics,
        "duration_ms": trained.duration_ms,
        "params": trained.params,
        "features": s.features,
        "target": s.target,
        "problem_type": s.problem_type,
        "medians": s.medians,
        "means": s.means,
        "stds": s.stds,
        "encoders": list(s.encoders),
        "classes": s.classes,
        "residual_std": s.residual_std,
    }
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.text(f"{base}/stats")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Read a model written by ``save_model``."""
    base = path.rstrip("/")
    facts = json.loads(spark.read.text(f"{base}/stats").first()[0])
    encoders = {
        name: spark.read.parquet(f"{base}/encoder={i}") for i, name in enumerate(facts["encoders"])
    }
    names = ("features", "target", "problem_type", "medians", "means", "stds", "classes", "residual_std")
    stats = FeatureStats(**{k: facts[k] for k in names}, encoders=encoders)
    return TrainedModel(
        facts["algorithm"],
        stats,
        PipelineModel.load(f"{base}/model"),
        facts["metrics"],
        facts["duration_ms"],
        facts["params"],
    )
