"""Cleaning requests given as a dictionary."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from framewise.operators import cleaning, relational

# Parameters each operation cannot do without.
REQUIRED = {
    "remove_duplicates": (),
    "fill_missing": ("column", "strategy"),
    "filter_rows": ("column", "operator", "value"),
    "cap_outliers": ("column",),
    "drop_column": ("column",),
}


def clean(df: DataFrame, request: dict[str, Any]) -> DataFrame:
    """Run one cleaning request ``{operation, column, strategy, operator, value, fill_value, percentile}``."""
    operation = request.get("operation")
    if operation not in REQUIRED:
        raise ValueError(f"Unknown operation '{operation}'. Use one of {', '.join(REQUIRED)}")
    missing = [p for p in REQUIRED[operation] if request.get(p) is None]
    if missing:
        raise ValueError(f"Operation '{operation}' needs {', '.join(missing)}")
    column = request.get("column", "")
    if operation == "remove_duplicates":
        return relational.remove_duplicates(df)
    if operation == "fill_missing":
        return cleaning.fill_missing(df, column, request["strategy"], request.get("fill_value"))
    if operation == "filter_rows":
        return relational.remove_rows(df, column, request["operator"], request["value"])
    if operation == "cap_outliers":
        return cleaning.cap_outliers(df, column, request.get("percentile") or 99.0)
    return relational.drop_column(df, column)
