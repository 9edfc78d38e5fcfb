"""Ordered feature steps: applied in one plan, appended, removed and replayed."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from framewise.operators import features

Step = dict[str, Any]

TRANSFORMS = {
    "date_decompose": features.date_decompose,
    "log_transform": features.log_transform,
    "one_hot": features.one_hot,
    "label_encode": features.label_encode,
}


def _apply(df: DataFrame, step: Step) -> DataFrame:
    kind, column = step["transform_type"], step["column"]
    if kind == "bin_quartile":
        return features.bin_quartile(df, column, step.get("params", {}).get("n_bins", 4))
    if kind == "interaction":
        first, separator, second = column.partition("__")
        if not separator:
            raise ValueError(f"'{column}' does not name two columns")
        return features.interaction(df, first, second)
    if kind not in TRANSFORMS:
        raise ValueError(f"Unknown transform '{kind}'")
    return TRANSFORMS[kind](df, column)


def apply_transforms(
    df: DataFrame, steps: Sequence[Step], skipped: dict[int, str] | None = None
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Run the steps in order; returns the table and, per source, the columns its step made.

    A step that cannot run is left out of the table and of the mapping; ``skipped`` gets its place and the reason.
    """
    made: dict[str, list[str]] = {}
    for place, step in enumerate(steps):
        try:
            after = _apply(df, step)
        except (ValueError, KeyError, AnalysisException) as reason:
            if skipped is not None:
                skipped[place] = str(reason)
            continue
        made[step["column"]] = [c for c in after.columns if c not in df.columns]
        df = after
    return df, made


def add_step(steps: Sequence[Step], step: Step) -> list[Step]:
    """The step list with one more at its end."""
    return [*steps, step]


def remove_step(steps: Sequence[Step], index: int) -> list[Step]:
    """The step list without the step at the index."""
    if not 0 <= index < len(steps):
        raise ValueError(f"No step at index {index}")
    return [s for i, s in enumerate(steps) if i != index]
