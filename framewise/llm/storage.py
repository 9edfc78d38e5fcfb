"""Intermediate tables in the folder that every executor of the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARROW_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 4 * 1024 * 1024
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_watchers: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a session on one machine may leave that setting out; it then gets a temporary folder. Anywhere else a
    missing setting is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framewise-")
    folder = f"{root.rstrip('/')}/framewise-{uuid.uuid4().hex}"
    for made in _watchers:
        made.append(folder)
    return folder


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that ``shared_folder`` names inside the block."""
    made: list[str] = []
    _watchers.append(made)
    try:
        yield made
    finally:
        _watchers[:] = [w for w in _watchers if w is not made]


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables that no result reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin and end inside the block delete their shuffle files at once, not when the JVM collects garbage."""
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts do not add up in a Python worker."""
    spark.conf.set(ARROW_BYTES_CONF, str(ARROW_BYTES))


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text, extra ...) with a null text as the empty one; other columns, whatever their names, are left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def release() -> None:
    """Give memory that a Python worker no longer needs back to the system; Spark keeps idle workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps or returns memory by its own rules
        pass


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers give their memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)
