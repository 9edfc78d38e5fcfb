"""Structured query requests: one dictionary in, one lazy DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from framewise.functions.columns import numeric_columns
from framewise.operators import aggregates, relational, timeseries


def run_query_spec(df: DataFrame, spec: dict[str, Any], order_by: Sequence[str] = ()) -> DataFrame:
    """Run ``{operation: groupby | top_n | distribution | filter | timeseries | correlation, …}``."""
    operation = spec.get("operation")
    columns = [c for c in spec.get("columns") or [] if c in df.columns]
    if operation == "distribution":
        if not columns:
            raise ValueError("The request names no column of the table")
        return aggregates.distribution(df, columns[0])
    if operation in ("groupby", "top_n"):
        return aggregates.spec_groupby(
            df,
            spec.get("group_by") or [],
            spec.get("aggregate") or {},
            spec.get("sort_ascending", False),
            spec.get("limit") or 10,
        )
    if operation == "timeseries":
        x = spec.get("x_col") or (columns[0] if columns else "")
        y = spec.get("y_col") or (columns[1] if len(columns) > 1 else "")
        return timeseries.spec_timeseries(df, x, y)
    if operation == "correlation":
        numeric = [c for c in columns if c in numeric_columns(df)]
        if len(numeric) < 2:
            raise ValueError("A correlation takes two numeric columns")
        return aggregates.spec_correlation(df, numeric[0], numeric[1])
    if operation == "filter":
        f = spec.get("filter") or {}
        return relational.spec_filter(
            df, f.get("column", ""), f.get("operator", ""), f.get("value"), order_by=order_by
        )
    raise ValueError(f"Unknown operation '{operation}'")
