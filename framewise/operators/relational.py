"""Filters, projections, computed columns, paging, sampling and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.columns import (
    field_type,
    is_integer,
    is_numeric,
    is_text,
    parse_timestamp,
    percent,
    ref,
    require_columns,
    require_numeric,
)

FILTER_OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "not_contains")
REMOVE_OPERATORS = ("gt", "lt", "gte", "lte", "eq", "ne", "contains", "notcontains")
COMPARISONS = {
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "gte": lambda a, b: a >= b,
    "lte": lambda a, b: a <= b,
}


def _canonical(op: str) -> str:
    return "not_contains" if op == "notcontains" else op


def _number_literal(df: DataFrame, name: str, value: Any) -> Column:
    """A literal of the column's own type where that is exact, so the scan can use the predicate."""
    number = float(value)
    if is_integer(field_type(df, name)) and number.is_integer() and abs(number) < 2**53:
        return F.lit(int(number))
    return F.lit(number)


def _as_number(df: DataFrame, name: str) -> Column:
    return ref(name) if is_numeric(field_type(df, name)) else ref(name).try_cast("double")


def _contains(df: DataFrame, name: str, value: Any) -> Column:
    pattern = str(value)
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"Invalid pattern '{pattern}': {exc}") from exc
    return ref(name).cast("string").rlike(f"(?i){pattern}")


def _equals(df: DataFrame, name: str, value: Any, ignore_case: bool) -> Column:
    dtype = field_type(df, name)
    if is_text(dtype):
        if ignore_case:
            return F.lower(ref(name)) == F.lit(str(value).lower())
        return ref(name) == F.lit(value) if isinstance(value, str) else F.lit(False)
    if is_numeric(dtype):
        # A text value never equals a number.
        if isinstance(value, str):
            return F.lit(False)
        return ref(name) == _number_literal(df, name, value)
    return ref(name) == F.lit(value)


def predicate(df: DataFrame, column: str, op: str, value: Any) -> Column:
    """Null-free truth value of one filter condition; missing values pass ``ne`` and ``not_contains``."""
    require_columns(df, column)
    op = _canonical(op)
    if op in COMPARISONS:
        try:
            literal = _number_literal(df, column, value)
        except (TypeError, ValueError) as exc:
            raise ValueError(f"'{value}' is not a number") from exc
        return COMPARISONS[op](_as_number(df, column), literal)
    if op == "eq":
        return _equals(df, column, value, ignore_case=True)
    if op == "ne":
        return ~F.coalesce(_equals(df, column, value, ignore_case=True), F.lit(False))
    if op == "contains":
        return _contains(df, column, value)
    if op == "not_contains":
        return ~F.coalesce(_contains(df, column, value), F.lit(False))
    raise ValueError(f"Unknown operator '{op}'")


def validate_conditions(conditions: Sequence[dict], columns: Sequence[str]) -> list[str]:
    """Problems found in a list of conditions, empty when all are usable."""
    problems = []
    for number, condition in enumerate(conditions, start=1):
        if condition.get("column") not in columns:
            problems.append(f"Condition {number}: column '{condition.get('column')}' not in dataset")
        if _canonical(str(condition.get("operator"))) not in FILTER_OPERATORS:
            problems.append(f"Condition {number}: unknown operator '{condition.get('operator')}'")
    return problems


def conditions_predicate(
    df: DataFrame, conditions: Sequence[dict], strict: bool = False
) -> Column | None:
    """AND of all usable conditions; unusable ones are skipped, or raise when strict."""
    if strict:
        problems = validate_conditions(conditions, df.columns)
        if problems:
            raise ValueError("; ".join(problems))
    parts = []
    for condition in conditions:
        try:
            parts.append(
                predicate(df, condition["column"], condition["operator"], condition["value"])
            )
        except (KeyError, ValueError):
            if strict:
                raise
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filter(df: DataFrame, conditions: Sequence[dict], strict: bool = False) -> DataFrame:
    """Rows that meet every condition ``{column, operator, value}``."""
    test = conditions_predicate(df, conditions, strict)
    return df if test is None else df.where(test)


def filter_stats(df: DataFrame, conditions: Sequence[dict]) -> DataFrame:
    """One row: rows before, rows after and the reduction in percent."""
    test = conditions_predicate(df, conditions)
    counts = df.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(F.lit(True) if test is None else test).alias("filtered_rows"),
    )
    removed = F.col("original_rows") - F.col("filtered_rows")
    return counts.withColumn("reduction_pct", percent(removed, F.col("original_rows"), 1))


def set_view(df: DataFrame, name: str, conditions: Sequence[dict]) -> DataFrame:
    """Keep a filtered view of the data under a name; setting it again replaces it."""
    view = apply_filter(df, conditions)
    view.createOrReplaceTempView(name)
    return view


def clear_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def active_view(df: DataFrame, name: str) -> DataFrame:
    """The filtered view kept under the name, or the data itself when none is set."""
    spark = df.sparkSession
    return spark.table(name) if spark.catalog.tableExists(name) else df


def remove_rows(df: DataFrame, column: str, op: str, value: Any) -> DataFrame:
    """Drop the rows that match; a missing value matches only ``ne`` and ``notcontains``."""
    require_columns(df, column)
    kind = "notcontains" if op == "not_contains" else op
    if kind not in REMOVE_OPERATORS:
        raise ValueError(f"Unknown operator '{op}'. Valid: {sorted(REMOVE_OPERATORS)}")
    if kind in COMPARISONS:
        test = COMPARISONS[kind](_as_number(df, column), _number_literal(df, column, value))
    elif kind in ("eq", "ne"):
        test = _equals(df, column, value, ignore_case=False)
        test = ~test if kind == "ne" else test
    else:
        test = _contains(df, column, value)
        test = ~test if kind == "notcontains" else test
    return df.where(~F.coalesce(test, F.lit(kind in ("ne", "notcontains"))))


def spec_filter(
    df: DataFrame, column: str, op: str, value: Any, n: int = 20, order_by: Sequence[Any] = ()
) -> DataFrame:
    """First n rows that match a query-spec comparison, with the number of matches in ``match_count``."""
    require_columns(df, column)
    names = {">": "gt", "<": "lt", ">=": "gte", "<=": "lte"}
    if op in names:
        test = COMPARISONS[names[op]](ref(column), F.lit(value))
    elif op in ("==", "="):
        test = _equals(df, column, value, ignore_case=False)
    elif op == "contains":
        test = _contains(df, column, value)
    else:
        test = F.lit(True)
    matches = df.where(test)
    total = matches.agg(F.count(F.lit(1)).alias("match_count"))
    page = (matches.orderBy(*order_by) if order_by else matches).limit(n)
    result = page.crossJoin(F.broadcast(total))
    return result.orderBy(*order_by) if order_by else result


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.drop(column)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, old)
    new = new.strip()
    if not re.fullmatch(r"\w+", new):
        raise ValueError(f"Invalid column name '{new}'")
    if new != old and new in df.columns:
        raise ValueError(f"Column '{new}' already exists")
    return df.withColumnRenamed(old, new)


@contextmanager
def _lenient_arithmetic(spark: SparkSession) -> Iterator[None]:
    """Plans analysed inside give null, not an error, for a division by zero or a bad cast."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _with_computed(df: DataFrame, name: str, expression: str) -> DataFrame:
    if not re.fullmatch(r"[a-zA-Z_]\w*", name):
        raise ValueError(f"Invalid column name '{name}'")
    text = expression.strip()
    if not text:
        raise ValueError("Expression cannot be empty")
    if re.search(r"(?i)\b(select|over|exists)\b", text):
        raise ValueError(f"Invalid expression '{expression}': only column arithmetic is allowed")
    operand = r"([\w.]+|\([^()]*\))"
    text = re.sub(rf"{operand}\s*\*\*\s*{operand}", r"power(\1, \2)", text)
    try:
        with _lenient_arithmetic(df.sparkSession):
            result = df.withColumn(name, F.expr(text))
    except AnalysisException as exc:
        raise ValueError(f"Invalid expression '{expression}': {exc}") from exc
    if result._jdf.queryExecution().analyzed().nodeName() == "Aggregate":
        raise ValueError(f"Invalid expression '{expression}': aggregates are not allowed")
    return result


def add_computed_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add, or replace, a column from an arithmetic or comparison expression over the columns."""
    return _with_computed(df, name, expression)


def preview_computed_column(
    df: DataFrame, name: str, expression: str, n: int = 5, order_by: Sequence[Any] = ()
) -> DataFrame:
    """First n values of an expression; the table stays as it is."""
    first = (df.orderBy(*order_by) if order_by else df).limit(n)
    return _with_computed(first, name, expression).select(ref(name))


def sample_records(
    df: DataFrame,
    n: int = 20,
    conditions: Sequence[dict] | None = None,
    offset: int = 0,
    order_by: Sequence[Any] = (),
) -> DataFrame:
    """A page of 1-50 rows and up to 8 columns in the given order."""
    rows = apply_filter(df, conditions or [])
    if order_by:
        rows = rows.orderBy(*order_by)
    page = rows.offset(max(0, offset)).limit(max(1, min(n, 50)))
    return page.select(*[ref(c) for c in df.columns[:8]])


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Text column to timestamps; what does not parse becomes missing."""
    require_columns(df, column)
    return df.withColumn(column, parse_timestamp(ref(column), field_type(df, column)))


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row; nulls count as equal."""
    return df.dropDuplicates()


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    """Seeded pseudo-random order that depends on the row's key only, never on its partition."""
    return F.xxhash64(*[ref(k) for k in key], F.lit(seed))


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by hash order of their key: the same rows on every run and layout."""
    return df.orderBy(hash_order(key, seed), *[ref(k) for k in key]).limit(n)


def scatter_sample(
    df: DataFrame, x: str, y: str, key: Sequence[str], n: int = 500, seed: int = 42
) -> DataFrame:
    """Up to n random (x, y) pairs without missing values, with Pearson r of the pairs shown."""
    require_numeric(df, x)
    require_numeric(df, y)
    pairs = sample_rows(df.where(ref(x).isNotNull() & ref(y).isNotNull()), key, n, seed)
    points = pairs.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    r = points.agg(
        F.try_divide(F.covar_pop("x", "y"), spread).alias("r"), F.count(F.lit(1)).alias("_n")
    )
    r = r.select(F.when(F.col("_n") >= 3, F.round("r", 3)).alias("r"))
    return points.crossJoin(F.broadcast(r))
