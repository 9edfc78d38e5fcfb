"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.storage import stored


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for each node of an edge; ``component`` is the smallest node that edges reach.

    ``edges`` has two columns of one ordered type. Loops and nulls are dropped, repeated edges count once. Each
    round sends every node to the smallest of itself and its neighbours and replaces the edges by those between the
    nodes so reached. A component's smallest node always stays, and at least half of the others go, so rounds grow
    with the logarithm of the size. Only minima per node are grouped; a hub's edges are joined, which adaptive
    execution splits. Each round ends in a stored table.
    """
    a, b = edges.columns
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    live = edges.where(F.col(a) != F.col(b)).select(pair(F.col(a), F.col(b)).alias("e")).select("e.*").distinct()
    live = stored(live, folder)
    found = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = found.select("node", F.col("node").alias("component"))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("least"))
        step = stored(smallest.select(F.col("a").alias("node"), F.least("a", "least").alias("to")), folder)
        ends = lambda side: step.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}"))
        moved = live.join(ends("a"), "a").join(ends("b"), "b").where(F.col("to_a") != F.col("to_b"))
        live = stored(moved.select(pair(F.col("to_a"), F.col("to_b")).alias("e")).select("e.*").distinct(), folder)
        # The steps are few and are joined once, where the result is used.
        joined = found.join(step.withColumnRenamed("node", "component"), "component", "left")
        found = joined.select("node", F.coalesce("to", "component").alias("component"))
    return stored(found, folder)
