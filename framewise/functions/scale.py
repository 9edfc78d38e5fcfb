"""Size checks and the distributed building blocks that replace single-task windows.

Every operator that has a cheap plan for small inputs asks ``is_small`` first. The answer comes from
Catalyst's size estimate of the plan, so it costs no job; an unknown size counts as large.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions.columns import ref

SMALL_INPUT_CONF = "spark.framewise.smallInputBytes"
SMALL_INPUT_BYTES = 64 * 1024 * 1024
FEW_ROWS = 100_000
#: Rows of a task that reads prepared rows again and again, and cells of a key's hash when rows are ranked by it.
TASK_ROWS = 1_000_000
HASH_CELLS = 1 << 14


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the result size, None when it has none."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:  # a remote session exposes no plan: treat the size as unknown
        return None


def is_small(df: DataFrame) -> bool:
    """True when one task can surely hold the whole input."""
    limit = int(df.sparkSession.conf.get(SMALL_INPUT_CONF, str(SMALL_INPUT_BYTES)))
    size = estimated_bytes(df)
    return size is not None and size <= limit


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise Spark picks the join itself."""
    return F.broadcast(df) if is_small(df) else df


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give a small input that arrives in few partitions one per core before repeated or heavy work on it.

    Larger inputs are not shuffled for this unless their number of rows is given: a file may come in a single split, and
    its splits do not follow the width of what is made of its rows. They then take a task per core, and more where a task
    would hold over ``TASK_ROWS`` rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is None:
        return df.repartition(cores) if is_small(df) else df
    return df.repartition(max(cores, math.ceil(rows / TASK_ROWS)))


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; keeps partitions and their order."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        # One machine's session may leave the setting out; elsewhere executors would not see each other's files.
        if folder is None and not context.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="framewise-checkpoint-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; one machine's session may leave that setting out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="framewise-")
    return f"{root.rstrip('/')}/framewise-{uuid.uuid4().hex}"


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """Freeze a table that is small by nature, count its rows, and broadcast it when there are at most ``FEW_ROWS``.

    Catalyst takes the size of an aggregate for that of its input, so the other side would be shuffled on what may be
    a handful of keys. Give narrow rows; a larger table is joined as Spark sees fit.
    """
    frozen = freeze(df)
    return F.broadcast(frozen) if frozen.count() <= FEW_ROWS else frozen


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_positions(
    df: DataFrame,
    order_by: Sequence[Column],
    name: str = "position",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add the 0-based rank of each row, per ``partition_by`` group when given.

    Small inputs use one window. Larger ones are range-partitioned on (group, order), sorted inside the
    partitions and frozen; a row's rank is its offset in its partition plus the rows in the partitions
    before it. A hot group or hot order value is cut over many partitions as long as the order columns
    tell its rows apart, and no task ever sees more than its range.
    """
    keys = [F.col(k) for k in partition_by]
    if is_small(df):
        window = Window.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(window).cast("long") - 1)

    full_order = [*keys, *order_by]
    arranged = df.repartitionByRange(shuffle_width(df.sparkSession), *full_order)
    frozen = freeze(arranged.sortWithinPartitions(*full_order))
    row_id = F.monotonically_increasing_id()
    tagged = frozen.withColumn("_row", row_id).select(
        "*",
        F.shiftright("_row", 33).alias("_part"),
        F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_slot"),
    )
    # One row per partition: the window below is bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    placed = tagged.join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + F.col("_slot")
    )
    if partition_by:
        first = placed.groupBy(*partition_by).agg(F.min(name).alias("_first"))
        first = first.select(*[F.col(k).alias(f"_k_{k}") for k in partition_by], "_first")
        same = None
        for k in partition_by:
            test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            same = test if same is None else same & test
        placed = placed.join(first, same).withColumn(name, F.col(name) - F.col("_first"))
    return placed.select(*df.columns, name)


def hash_positions(df: DataFrame, key: Sequence[str], seed: int, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based rank of each row by its key's hash, then its key, per ``partition_by`` group when given.

    Small inputs are ranked as they are. In larger ones the hash's leading bits cut each group into even cells: one
    shuffle ranks the rows inside their cell, and the rows of the cells before it come from counts. Only rows with one key
    cannot be told apart.
    """
    place = F.xxhash64(*[ref(c) for c in key], F.lit(seed))
    if is_small(df):
        return row_positions(df, [place, *[ref(c) for c in key]], name, partition_by)
    bits = HASH_CELLS.bit_length() - 1
    tagged = df.withColumn("_hash", place).withColumn("_cell", F.shiftright("_hash", 64 - bits).cast("int"))
    cell = [*[ref(k) for k in partition_by], F.col("_cell")]
    before = Window.partitionBy(*cell[:-1]).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    # At most HASH_CELLS rows per group, so that a few groups' counts can be broadcast.
    starts = counts.select(
        *[ref(k).alias(f"_k{i}") for i, k in enumerate(partition_by)],
        F.col("_cell").alias("_kcell"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_cell") == F.col("_kcell")
    for i, k in enumerate(partition_by):
        same = same & ref(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*cell).orderBy("_hash", *[ref(c) for c in key])
    ranked = tagged.withColumn("_inside", F.row_number().over(inside).cast("long") - 1)
    placed = ranked.join(broadcast_if_few(starts), same)
    return placed.withColumn(name, F.col("_start") + F.col("_inside")).select(*[ref(c) for c in df.columns], name)


def with_halo(df: DataFrame, position: str, reach: int, chunk: int = 100_000) -> DataFrame:
    """Cut a positioned series into chunks and copy the ``reach`` rows before each chunk into it.

    Adds ``_chunk`` and ``_own`` (false for the copies), so a trailing window per chunk sees the same rows
    as one window over the whole series.
    """
    own = F.floor(F.col(position) / chunk)
    last = F.floor((F.col(position) + reach) / chunk)
    return df.select(
        "*", F.explode(F.sequence(own, last)).alias("_chunk")
    ).withColumn("_own", F.col("_chunk") == F.floor(F.col(position) / chunk))
