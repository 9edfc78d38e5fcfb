"""Exact interpolated percentiles without a value map per group.

Spark's ``percentile`` keeps a value -> count map per group in one aggregation buffer. Here equal values are
counted first and the distinct ones ranked. A small input is ranked by one sort per group. Beyond the size check
the same numbers come from a selection in three steps over the counted values, each of which only sums counts per
cell: cells by the logarithm of the value, then even cells between the ends of the cell that holds the rank, then the
ranks inside the one cell that is left. Which cell holds a rank follows from the counts, so no estimate can miss it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import ref
from framewise.functions.scale import broadcast_if_small, is_small

#: Cells per unit of the logarithm in the first step, and even cells in the second.
LOG_CELLS = 64
CELLS = 1_000


def group_percentiles(
    df: DataFrame,
    group_by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """One row per group (one row in all without groups) with a column per named probability.

    Missing values are left out; interpolation is linear between the two closest ranks. With ``weight`` a row
    stands for so many equal ones.
    """
    times = F.lit(1) if weight is None else ref(weight)
    base = df.select(
        *[ref(g).alias(g) for g in group_by], ref(value).cast("double").alias("_v"), times.cast("long").alias("_w")
    ).where(F.col("_v").isNotNull())
    if is_small(base):
        return _rank_groups(base, list(group_by), probabilities)
    return _select_ranks(base, list(group_by), probabilities)


def _rank_groups(
    base: DataFrame, groups: list[str], probabilities: dict[str, float]
) -> DataFrame:
    """Ranks from one sort of the distinct values of each group, each in one (spilling) task."""
    counted = base.groupBy(*groups, "_v").agg(F.sum("_w").alias("_c"))
    sizes = counted.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    running = (
        Window.partitionBy(*groups)
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("_end", F.sum("_c").over(running)).withColumn(
        "_begin", F.col("_end") - F.col("_c")
    )
    sized = _null_safe(ranked, broadcast_if_small(sizes), groups, "inner") if groups else (
        ranked.crossJoin(F.broadcast(sizes))
    )
    used, measures = F.lit(False), []
    for name, p in probabilities.items():
        rank = (F.col("_n") - 1) * F.lit(float(p))
        below, above = (
            (F.col("_begin") <= r) & (F.col("_end") > r) for r in (F.floor(rank), F.ceil(rank))
        )
        used = used | below | above
        low, high = F.max(F.when(below, F.col("_v"))), F.max(F.when(above, F.col("_v")))
        measures.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    hits = sized.where(used)
    return hits.groupBy(*groups).agg(*measures) if groups else hits.agg(*measures)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on shared keys where null equals null, keeping one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])


def _select_ranks(
    base: DataFrame, groups: list[str], probabilities: dict[str, float]
) -> DataFrame:
    # Equal values collapse before the shuffle, so a value held by a third of all rows is one row here.
    counted = base.groupBy(*groups, "_v").agg(F.sum("_w").alias("_c"))
    magnitude = F.floor(F.log1p(F.abs("_v")) * LOG_CELLS).cast("long")
    finite = F.abs("_v") < F.lit(math.inf)
    # Infinities, and NaN as the largest value, lie in cells of their own at the ends.
    coarse = F.when(F.isnan("_v"), F.lit(1 << 41)).when(finite, F.signum("_v").cast("long") * magnitude)
    coarse = F.coalesce(coarse, F.when(F.col("_v") > 0, F.lit(1 << 40)).otherwise(F.lit(-(1 << 40))))
    spread = counted.withColumn("_cell", coarse)
    sizes = spread.groupBy(*groups, "_cell").agg(
        F.sum("_c").alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # The logarithm of a double has under 710 units for either sign: the running sum is over a bounded number of rows.
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    sizes = sizes.withColumns({"_below": F.coalesce(F.sum("_k").over(before), F.lit(0)), "_n": F.sum("_k").over(whole)})
    ranks = []
    for i, p in enumerate(probabilities.values()):
        rank = (F.col("_n") - 1) * F.lit(float(p))
        for part, place in ((0, F.floor(rank)), (1, F.ceil(rank))):
            ranks.append(
                F.struct(
                    F.lit(2 * i + part).alias("_p"), place.alias("_r"), (rank - F.floor(rank)).alias("_f")
                )
            )
    hit = sizes.select("*", F.explode(F.array(*ranks)).alias("_s")).select("*", "_s.*").drop("_s")
    hit = hit.where((F.col("_below") <= F.col("_r")) & (F.col("_below") + F.col("_k") > F.col("_r")))
    # One row per group, probability and side from here on: the cells that hold the ranks.
    wanted = hit.select(*groups, "_cell", "_p", "_r", "_f", "_below", "_lo", "_hi")
    placed = _null_safe(spread, broadcast_if_small(wanted), [*groups, "_cell"], "inner")
    width = F.col("_hi") - F.col("_lo")
    even = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * CELLS), F.lit(CELLS - 1))
    placed = placed.withColumn("_even", F.when(F.col("_hi") > F.col("_lo"), even).otherwise(F.lit(0)).cast("int"))
    slot = [*groups, "_p"]
    inner = placed.groupBy(*slot, "_even").agg(
        F.sum("_c").alias("_k"), F.first("_r").alias("_r"), F.first("_below").alias("_below")
    )
    before = Window.partitionBy(*slot).orderBy("_even").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_k").over(before), F.lit(0)))
    inner = inner.where((F.col("_start") <= F.col("_r")) & (F.col("_start") + F.col("_k") > F.col("_r")))
    kept = _null_safe(placed, broadcast_if_small(inner.select(*slot, "_even", "_start")), [*slot, "_even"], "inner")
    inside = (
        Window.partitionBy(*slot).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = kept.withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    found = ranked.where((F.col("_end") - F.col("_c") <= F.col("_r")) & (F.col("_end") > F.col("_r")))
    side = lambda i: F.max(F.when(F.col("_p") == i, F.col("_v")))
    picked = [
        (side(2 * i) + (side(2 * i + 1) - side(2 * i)) * F.max(F.when(F.col("_p") == 2 * i, F.col("_f")))).alias(name)
        for i, name in enumerate(probabilities)
    ]
    return found.groupBy(*groups).agg(*picked) if groups else found.agg(*picked)


def weighted_median(value: Column, weight: Column) -> Column:
    """Median of integer-weighted values of a bounded table, as an aggregate expression."""
    return F.percentile(value, F.lit(0.5), weight)
