"""Integer k-means whose nearest-centroid search is ordered by component means.

Vectors are turned into integers floor(scale * x). Centroids are sorted by the sum of their components; a vector starts
at its own sum and goes outward in both directions. With S the sum and V the deviation (root of the squared distance
to the mean) over n components, the squared distance is at least (Sx - Sc)^2 / n + (Vx - Vc)^2. Once the first term
alone passes the best distance so far, its direction is closed (equal-average rule); a centroid whose whole bound passes
it is skipped (equal-variance rule). Bounds are compared with a margin for rounding, and what passes gets its exact
distance in 64-bit integers, so ties go to the smaller number as in a full search.

A vector is used when it has exactly ``size`` components, none null or non-finite, and none beyond 2^27 after scaling
(beyond it distances leave 64 bits; such vectors are left out like non-finite ones). Rows without vec_id are assigned
but start no centroid; rows that share a vec_id are vectors of their own, ordered by their components where one
starts a centroid. Fewer usable vectors than centroids give fewer centroids, an empty table no rows. Other columns
are not read. Centroids (k x size integers) are the only state on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.storage import shared_folder, stored

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 27
_MARGIN = 1e-9


class Centroids:
    """Centroids in the order of their sums, with what the bounds need."""

    def __init__(self, values: np.ndarray) -> None:
        total = values.sum(axis=1)
        self.number = np.argsort(total, kind="stable")
        self.values = values[self.number]
        self.total = total[self.number]
        self.deviation = _deviation(self.values, self.total)


def _deviation(values: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", values, values) - total.astype(float) ** 2 / values.shape[1], 0))


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row of int64 vectors."""
    rows, size = vectors.shape
    k = len(centroids.total)
    total = vectors.sum(axis=1)
    deviation = _deviation(vectors, total)
    start = np.searchsorted(centroids.total, total)
    best = np.full(rows, np.iinfo(np.int64).max)
    number = np.full(rows, k)
    live = {1: np.arange(rows), -1: np.arange(rows)}
    for step in range(k):
        for way in (1, -1):
            at = live[way]
            place = start[at] + step if way == 1 else start[at] - 1 - step
            inside = (place >= 0) & (place < k)
            at, place = at[inside], place[inside]
            limit = best[at] * (1 + _MARGIN) + 1
            apart = (total[at] - centroids.total[place]).astype(float) ** 2 / size
            reached = apart <= limit
            at, place = at[reached], place[reached]
            live[way] = at
            near = apart[reached] + (deviation[at] - centroids.deviation[place]) ** 2 * (1 - _MARGIN) - _MARGIN * apart[reached] <= limit[reached]
            at, place = at[near], place[near]
            gap = vectors[at] - centroids.values[place]
            exact = np.einsum("ij,ij->i", gap, gap)
            named = centroids.number[place]
            won = (exact < best[at]) | ((exact == best[at]) & (named < number[at]))
            best[at[won]], number[at[won]] = exact[won], named[won]
    return number, best


def integer_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors as integers."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale <= LIMIT - 1))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == size) & fine
    return vectors.select("vec_id", "embedding").where(usable).select("vec_id", scaled.cast("array<int>").alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, size)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, count, componentwise sums) of the assigned vectors, added up over the cluster."""
    size, ways = centroids.shape[1], Centroids(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), size)
            number, _ = nearest(v, ways)
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(number, minlength=len(count))
        own = np.flatnonzero(count)
        columns = [pa.array(own), pa.array(count[own]), *[pa.array(total[own, j]) for j in range(size)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *[f"s{j}" for j in range(size)]])

    names = [f"s{j}" for j in range(size)]
    parts = vectors.select("v").mapInArrow(add, "cluster long, n long, " + ", ".join(f"{s} long" for s in names))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect()


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    whole = stored(integer_vectors(vectors, size, scale), folder)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.where(F.col("vec_id").isNotNull()).orderBy(mark, "v").limit(clusters).collect()
    # Without any id no centroid starts; rows without ids alone then have nothing to be assigned to.
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    for _ in range(rounds if len(first) else 0):
        moved = centroids.copy()
        for r in _sums(whole, centroids):
            moved[r["cluster"]] = [s // r["n"] for s in r[2:]]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    ways = Centroids(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(_matrix(batch.column(1), size), ways)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    given = whole.schema["vec_id"].dataType.simpleString()
    source = whole if len(first) else whole.limit(0)
    placed = stored(source.mapInArrow(assign, f"vec_id {given}, cluster int, distance long"), folder)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(list(zip(range(len(digest)), digest, centroids.tolist(), strict=True)), "cluster int, centroid_sha256 string, centroid array<long>")
    spread = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole_sum = placed.agg(F.sum("distance").alias("inertia"))
    # At most one row for each centroid.
    facts = facts.join(spread, "cluster").crossJoin(F.broadcast(whole_sum))
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
