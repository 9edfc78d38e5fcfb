"""Column helpers: safe column names, schema roles and small expression builders."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_TYPES = (T.FloatType, T.DoubleType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*FLOAT_TYPES, T.DecimalType))


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGER_TYPES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATE_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")


def require_numeric(df: DataFrame, name: str) -> None:
    require_columns(df, name)
    if not is_numeric(field_type(df, name)):
        raise ValueError(f"Column '{name}' is not numeric")


def clean_float(column: Column, dtype: T.DataType) -> Column:
    """NaN and both infinities read as missing; other types pass through."""
    if not isinstance(dtype, FLOAT_TYPES):
        return column
    bad = F.isnan(column) | (F.abs(column) == F.lit(math.inf))
    return F.when(~bad, column)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN, +Inf and -Inf into null in every floating point column."""
    return df.select(
        *[clean_float(ref(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def as_text(column: Column, dtype: T.DataType) -> Column:
    """Text form used for labels and value counts; -0.0 and 0.0 share one label."""
    if isinstance(dtype, FLOAT_TYPES):
        column = column + F.lit(0.0)
    return column.cast("string")


def ladder(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First label whose bound is <= value, bounds given from high to low."""
    result: Column | None = None
    for bound, label in steps:
        test = value >= F.lit(bound)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    assert result is not None
    return F.when(value.isNotNull(), result.otherwise(F.lit(otherwise)))


def ladder_below(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First label whose bound is > value, bounds given from low to high."""
    result: Column | None = None
    for bound, label in steps:
        test = value < F.lit(bound)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    assert result is not None
    return F.when(value.isNotNull(), result.otherwise(F.lit(otherwise)))


def ladder_up_to(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First label whose bound is >= value, bounds given from low to high."""
    result: Column | None = None
    for bound, label in steps:
        test = value <= F.lit(bound)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    assert result is not None
    return F.when(value.isNotNull(), result.otherwise(F.lit(otherwise)))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole rounded, 0 when the whole is 0."""
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


# The date shapes recognised in text, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MM-dd-yyyy",
    "MMM d, yyyy",
    "MMM yyyy",
)
DATE_LIKE = r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})"


def parse_timestamp(column: Column, dtype: T.DataType) -> Column:
    """Timestamp without zone, null when the text does not parse."""
    if isinstance(dtype, T.TimestampNTZType):
        return column
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    text = F.trim(column.cast("string"))
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    # A bare number such as "2023" is not a date here, it is a number in a text column.
    return F.when(~text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.coalesce(*tries))


def seconds(column: Column) -> Column:
    """Timestamp as fractional seconds since the epoch."""
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def day_string(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
