"""Structured Streaming forms of scoring, usage counts and feedback pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewise.operators.ml import TrainedModel
from framewise.operators.scoring import score_batch
from framewise.sources.logs import prediction_log


def predictions_by_day(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Predictions per deployment and day; a day is final once the watermark has passed its end.

    State is one counter per open day and deployment. Events later than ``delay`` are dropped.
    """
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        timed.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day").alias("day"), "deployment_id")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("deployment_id", F.date_format("day.start", "yyyy-MM-dd").alias("date"), "count")
    )


def score_stream(
    arriving: DataFrame,
    trained: TrainedModel,
    deployment_id: str,
    key: Sequence[str],
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Score arriving rows and append them to the prediction log under ``path``.

    The file sink with its checkpoint writes every row once, also after a restart.
    """
    scored = score_batch(arriving, trained)
    rows = prediction_log(scored, deployment_id, trained.stats.features, key)
    rows = rows.withColumn("log_date", F.to_date("created_at"))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("log_date")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def pair_feedback(
    feedback: DataFrame, log: DataFrame, horizon: str = "30 days", delay: str = "1 day"
) -> DataFrame:
    """Left join of a feedback stream to the prediction stream by id.

    A prediction is kept in state for ``horizon`` (an outcome that comes later stays unpaired), so both sides
    carry a watermark and the join a time range.
    """
    outcomes = feedback.select(
        "deployment_id",
        "prediction_log_id",
        "actual_value",
        "actual_label",
        F.col("created_at").cast("timestamp").alias("feedback_at"),
    ).withWatermark("feedback_at", delay)
    predictions = log.select(
        F.col("id").alias("_id"),
        "prediction",
        "prediction_numeric",
        F.col("created_at").cast("timestamp").alias("predicted_at"),
    ).withWatermark("predicted_at", delay)
    span = F.expr(f"INTERVAL {horizon}")
    match = (
        (F.col("prediction_log_id") == F.col("_id"))
        & (F.col("feedback_at") >= F.col("predicted_at"))
        & (F.col("feedback_at") <= F.col("predicted_at") + span)
    )
    return outcomes.join(predictions, match, "left").drop("_id")
