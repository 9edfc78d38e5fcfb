"""Reading, extracting, refreshing and exporting tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.columns import clean_float, normalize_missing, ref
from framewise.operators.relational import apply_filter

FORMATS = ("csv", "parquet", "json", "orc")


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    """Load a table with NaN and infinities read as missing.

    CSV files carry a header; without a schema the types are inferred, which costs one more read of the
    file, so pass a schema for large inputs. Rows that do not fit the schema fail the read.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format '{fmt}'. Use one of {', '.join(FORMATS)}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
        if schema is None:
            reader = reader.option("inferSchema", True)
    return normalize_missing(reader.format(fmt).load(path))


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views a query can read."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name")).orderBy("name")


def extract_select(
    spark: SparkSession, query_or_table: str, jdbc_options: dict[str, str] | None = None
) -> DataFrame:
    """Rows of a registered table or of a SELECT; an empty result is an error.

    With ``jdbc_options`` (url, driver, user …) the same request is pushed to that database.
    """
    text = query_or_table.strip().rstrip(";")
    is_name = re.fullmatch(r"[\w.]+", text) is not None
    if not is_name and not re.match(r"(?i)select\b", text):
        raise ValueError("An extract must be a SELECT")
    if jdbc_options is not None:
        reader = spark.read.format("jdbc").options(**jdbc_options)
        df = (reader.option("dbtable", text) if is_name else reader.option("query", text)).load()
    else:
        df = spark.table(text) if is_name else spark.sql(text)
    if df.isEmpty():
        raise ValueError("The query returned no rows")
    return normalize_missing(df)


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """First n rows in the given order (in table order when none is given)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def schema_diff(
    spark: SparkSession, old_columns: Sequence[str], new: DataFrame, required: Sequence[str] = ()
) -> DataFrame:
    """One row: added and removed columns, required columns now missing, and whether models still fit."""
    added = sorted(set(new.columns) - set(old_columns))
    removed = sorted(set(old_columns) - set(new.columns))
    missing = sorted(set(required) - set(new.columns))
    names = T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            T.StructField("new_columns", names),
            T.StructField("removed_columns", names),
            T.StructField("feature_columns_missing", names),
            T.StructField("compatible", T.BooleanType()),
        ]
    )
    return spark.createDataFrame([(added, removed, missing, not missing)], schema)


def compare_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row per column of either table: column, status (added, removed or kept), types, whether the type differs, missing
    share and rows on both sides. Each table is read once; missing includes NaN and infinities."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = F.count(F.lit(1))
        known = [F.count(clean_float(ref(f.name), f.dataType)).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
        structs = [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias(f"{tag}_type"),
                F.round(F.try_divide((F.col("_rows") - F.col(f"k{i}")) * 100, F.col("_rows")), 2).alias(f"{tag}_missing_pct"),
                F.col("_rows").alias(f"{tag}_rows"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        return df.agg(rows.alias("_rows"), *known).select(F.inline(F.array(*structs)))

    # A row per column on both sides.
    both = side(old, "old").join(side(new, "new"), "column", "full")
    status = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("kept")
    differs = F.coalesce(F.col("old_type") != F.col("new_type"), F.lit(False))
    facts = ("old_type", "new_type", "old_missing_pct", "new_missing_pct", "old_rows", "new_rows")
    return both.select("column", status.alias("status"), differs.alias("type_differs"), *facts).orderBy("column")


def refresh_table(
    new: DataFrame,
    path: str,
    old_columns: Sequence[str],
    required: Sequence[str] = (),
    version: str | None = None,
) -> tuple[str, DataFrame]:
    """Write the new data next to the old under a fresh version folder and report the schema change.

    The folder being read is never overwritten, so running queries keep their files.
    """
    target = f"{path.rstrip('/')}/version={version or uuid.uuid4().hex}"
    new.write.mode("errorifexists").parquet(target)
    return target, schema_diff(new.sparkSession, old_columns, new, required)


def export_table(
    df: DataFrame, path: str, conditions: Sequence[dict] | None = None, fmt: str = "csv"
) -> str:
    """Write the (filtered) table; a filtered export carries ``_filtered`` in its name."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format '{fmt}'. Use one of {', '.join(FORMATS)}")
    target = path.rstrip("/")
    if conditions:
        df = apply_filter(df, conditions)
        target += "_filtered"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(target)
    return target


def export_name(name: str, conditions: Sequence[dict] | None) -> str:
    """File name of an export."""
    stem, dot, suffix = name.rpartition(".")
    mark = "_filtered" if conditions else ""
    return f"{stem}{mark}.{suffix}" if dot else f"{name}{mark}"
