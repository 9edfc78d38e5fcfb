"""Registered queries with their SQL counterparts."""

from framewise.catalog import (  # noqa: F401  (each module registers its queries)
    exact,
    grouping,
    models,
    monitoring,
    preparation,
    profiling,
    relational,
    series,
)
from framewise.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
