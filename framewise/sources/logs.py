"""Append-only prediction and feedback logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import field_type, is_numeric, ref, require_columns


def json_scalar(value: Column) -> Column:
    """JSON text of a single value."""
    wrapped = F.to_json(F.array(value))
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


def json_label(text: Column) -> Column:
    """Value of a JSON scalar as plain text, null when it does not parse."""
    return F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")


def prediction_log(
    scored: DataFrame,
    deployment_id: str,
    features: Sequence[str],
    key: Sequence[str],
    created_at: Column | None = None,
) -> DataFrame:
    """Log rows of scored rows.

    The id is a digest of deployment, key and time, so a repeated task writes the same ids.
    """
    require_columns(scored, "prediction", *features, *key)
    when = F.current_timestamp() if created_at is None else created_at
    numeric = is_numeric(field_type(scored, "prediction"))
    number = ref("prediction").cast("double") if numeric else F.lit(None).cast("double")
    confidence = ref("confidence") if "confidence" in scored.columns else F.lit(None)
    stamped = scored.withColumn("_at", when)
    digest = F.sha2(
        F.concat_ws("|", F.lit(deployment_id), *[ref(k).cast("string") for k in key], F.col("_at").cast("string")),
        256,
    )
    return stamped.select(
        digest.alias("id"),
        F.lit(deployment_id).alias("deployment_id"),
        F.to_json(F.struct(*[ref(f) for f in features])).alias("input_features"),
        json_scalar(ref("prediction")).alias("prediction"),
        number.alias("prediction_numeric"),
        confidence.cast("double").alias("confidence"),
        F.col("_at").alias("created_at"),
    )


def append_prediction_log(rows: DataFrame, path: str) -> None:
    """Append log rows under one folder per day, which later day ranges prune to."""
    rows.withColumn("log_date", F.to_date("created_at")).write.mode("append").partitionBy(
        "log_date"
    ).parquet(path)


def feedback_records(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Feedback with an outcome; ``is_correct`` is derived from the stored prediction when not given."""
    require_columns(feedback, "deployment_id", "prediction_log_id", "actual_value", "actual_label", "is_correct")
    usable = feedback.where(F.col("actual_value").isNotNull() | F.col("actual_label").isNotNull())
    stored = log.select(
        F.col("id").alias("prediction_log_id"), json_label(F.col("prediction")).alias("_stored")
    )
    joined = usable.join(stored, "prediction_log_id", "left")
    derived = F.when(F.col("actual_label") != "", F.col("_stored") == F.col("actual_label"))
    correct = F.coalesce("is_correct", derived)
    return joined.withColumn("is_correct", correct).select(*feedback.columns)


def record_feedback(feedback: DataFrame, log: DataFrame, path: str) -> None:
    """Append feedback records; rows without any outcome are an error."""
    empty = feedback.where(F.col("actual_value").isNull() & F.col("actual_label").isNull())
    if not empty.isEmpty():
        raise ValueError("Provide at least one of: actual_value or actual_label")
    feedback_records(feedback, log).write.mode("append").parquet(path)


def prediction_log_page(
    log: DataFrame, deployment_id: str, limit: int = 20, offset: int = 0, feature_schema: str | None = None
) -> DataFrame:
    """A page of 1-100 predictions of a deployment, newest first, with the JSON decoded."""
    n = max(1, min(limit, 100))
    page = (
        log.where(F.col("deployment_id") == deployment_id)
        .orderBy(F.desc("created_at"), "id")
        .offset(max(0, offset))
        .limit(n)
    )
    schema = feature_schema or "map<string, string>"
    return page.select(
        "id",
        F.from_json("input_features", schema).alias("input_features"),
        json_label(F.col("prediction")).alias("prediction"),
        "confidence",
        "created_at",
    )
