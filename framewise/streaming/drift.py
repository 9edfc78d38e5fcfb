"""Drift, idle deployments and alerts over a stream of predictions.

State per deployment is a counter, the time of the latest prediction, and the first and last ``window`` predictions by
(created_at, id), so its size has a bound and arrival order does not matter: a row that comes late but within the
watermark takes its place among them. Every result is computed from that state by the columns that the batch operators
use, so a stream read to its end gives what they give, restarts included.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewise.operators.monitoring import WINDOW, class_drift_columns, numeric_drift_columns

_ROW = "struct<created_at: timestamp, id: string, prediction_numeric: double, prediction: string>"
ENDS = f"deployment_id string, predictions long, last_predicted_at timestamp, idle boolean, first array<{_ROW}>, last array<{_ROW}>"
#: Times in microseconds; the two ends column by column.
_SIDE = "at array<long>, id array<string>, number array<double>, text array<string>"
_STATE = f"predictions long, latest long, {', '.join(f'first_{x}, last_{x}' for x in _SIDE.split(', '))}"


def _rows(frame: pd.DataFrame) -> list[tuple]:
    at = frame["created_at"].astype("datetime64[us]").astype("int64")
    number = [None if pd.isna(x) else float(x) for x in frame["prediction_numeric"]]
    text = [None if pd.isna(x) else x for x in frame["prediction"]]
    # The number's place in the tuple is never compared: ids tell rows apart, and equal rows are equal in all.
    return [(a, i, str(n), n, t) for a, i, n, t in zip(at.tolist(), frame["id"].tolist(), number, text, strict=True)]


def _listed(rows: list[tuple]) -> list[dict]:
    return [{"created_at": pd.Timestamp(a, unit="us"), "id": i, "prediction_numeric": n, "prediction": t} for a, i, _, n, t in rows]


def prediction_ends(log: DataFrame, window: int = WINDOW, delay: str = "1 day", idle: str = "1 day") -> DataFrame:
    """A row for each deployment that a micro-batch brings predictions of: predictions so far, latest time, first and last
    ``window`` predictions. Once the watermark is ``idle`` past the latest prediction, a row with ``idle`` true follows.

    Rows later than ``delay`` are dropped by the watermark; rows without time, id or deployment are left out.
    """
    quiet = pd.Timedelta(idle) // pd.Timedelta(milliseconds=1)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, latest, first, last = 0, 0, [], []
        if state.exists:
            count, latest, *sides = state.get
            first, last = ([(a, i, str(n), n, t) for a, i, n, t in zip(*sides[k::2], strict=True)] for k in (0, 1))
        expired = state.hasTimedOut
        if not expired:
            by = lambda r: (r[0], r[1])
            for frame in frames:
                rows = _rows(frame)
                count += len(rows)
                first = heapq.nsmallest(window, [*first, *rows], key=by)
                last = heapq.nlargest(window, [*last, *rows], key=by)[::-1]
            latest = last[-1][0]
            turned = [list(x) for rows in (first, last) for x in zip(*[(a, i, n, t) for a, i, _, n, t in rows], strict=True)]
            state.update((count, latest, *[turned[4 * k + c] for c in range(4) for k in (0, 1)]))
            state.setTimeoutTimestamp(max(latest // 1000 + quiet, state.getCurrentWatermarkMs() + 1))
        out = {"deployment_id": key[0], "predictions": count, "last_predicted_at": pd.Timestamp(latest, unit="us"), "idle": expired}
        yield pd.DataFrame({**{k: [v] for k, v in out.items()}, "first": [_listed(first)], "last": [_listed(last)]})

    timed = log.select("deployment_id", "id", "prediction_numeric", "prediction", F.col("created_at").cast("timestamp").alias("created_at"))
    timed = timed.dropna(subset=["deployment_id", "id", "created_at"]).withWatermark("created_at", delay)
    return timed.groupBy("deployment_id").applyInPandasWithState(update, ENDS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drift_stream(ends: DataFrame, deployments: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """Drift after each update of ``prediction_ends``: numeric and by label, or by each deployment's problem type."""
    numeric, classes = numeric_drift_columns(window), class_drift_columns(window)
    names = ["deployment_id", "predictions", "last_predicted_at", "idle"]
    if deployments is None:
        shown = [c.alias(f"numeric_{k}" if k in ("status", "drift_score") else k) for k, c in numeric.items()]
        shown += [c.alias(f"class_{k}" if k != "tvd" else k) for k, c in classes.items()]
        return ends.select(*names, *shown)
    kind = F.coalesce("problem_type", F.lit("regression"))
    kinds = deployments.select(F.col("id").alias("deployment_id"), kind.alias("problem_type"), "algorithm")
    regression = F.col("problem_type") == "regression"
    either = lambda k: F.when(regression, numeric[k]).otherwise(classes[k]).alias(k)
    return ends.join(kinds, "deployment_id").select(*names, "problem_type", "algorithm", either("status"), either("drift_score"))


def alert_stream(ends: DataFrame, deployments: DataFrame, window: int = WINDOW) -> DataFrame:
    """Alerts of the active deployments as predictions arrive: drift_detected and no_predictions (days since the latest,
    as the watermark has it, are at least ``idle`` of ``prediction_ends``)."""
    moved = drift_stream(ends, deployments.where("is_active"), window)
    drifted = ~F.col("idle") & (F.col("drift_score") >= 60)
    critical = drifted & (F.col("drift_score") >= 80)
    return moved.where(drifted | F.col("idle")).select(
        "deployment_id",
        F.coalesce("algorithm", F.lit("model")).alias("algorithm"),
        F.when(critical, "critical").otherwise("warning").alias("severity"),
        F.when(F.col("idle"), "no_predictions").otherwise("drift_detected").alias("type"),
        F.when(~F.col("idle"), F.col("drift_score").cast("double")).alias("value"),
        "last_predicted_at",
    )


def latest(updates: DataFrame) -> DataFrame:
    """Of stored update rows, the last one of each deployment (the one that counts most predictions)."""
    rest = F.struct(*[c for c in updates.columns if c != "deployment_id"])
    return updates.groupBy("deployment_id").agg(F.max_by(rest, F.struct("predictions", "last_predicted_at")).alias("_row")).select("deployment_id", "_row.*")
