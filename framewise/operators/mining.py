"""K-means segments with their profiles, and isolation-forest anomalies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import numeric_columns, ref
from framewise.functions.quantiles import group_percentiles
from framewise.functions.scale import is_small, spread
from framewise.operators.aggregates import unpivot_numeric

MIN_ROWS = 10
MAX_CLUSTERS = 8
TREES = 100
TREE_ROWS = 256


def _usable(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    numeric = numeric_columns(df)
    picked = [c for c in columns or [] if c in numeric] or numeric
    if not picked:
        raise ValueError("No numeric columns available")
    return picked


def clusters(
    df: DataFrame, columns: Sequence[str] | None = None, k: int | None = None, seed: int = 42
) -> DataFrame:
    """Complete rows with a ``cluster`` id, 0 being the largest.

    Features are standardised. ``k`` is held in 2-8; without it the best mean silhouette over 2..8 decides.
    """
    features = _usable(df, columns)
    rows = df.dropna(subset=features)
    n = rows.count()
    if n < MIN_ROWS:
        raise ValueError(f"Need at least {MIN_ROWS} complete rows for clustering (got {n})")
    values = [ref(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]
    # Of many rows, only the features are dealt out and kept: every round reads them again.
    narrow = not is_small(rows)
    dealt = spread(rows.select(*values), n) if narrow else spread(rows).select("*", *values)
    prepare = Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        ]
    )
    standard = prepare.fit(dealt)
    scaled = standard.transform(dealt)
    scaled = (scaled.select("_x") if narrow else scaled).persist()
    try:
        top = min(MAX_CLUSTERS, n - 1)

        def fit(size: int):
            model = KMeans(k=size, seed=seed, featuresCol="_x", predictionCol="_c").fit(scaled)
            return model

        if k is not None:
            model = fit(max(2, min(int(k), top)))
        else:
            judge = ClusteringEvaluator(featuresCol="_x", predictionCol="_c")
            best, model = -1.0, None
            for size in range(2, top + 1):
                candidate = fit(size)
                if sum(1 for s in candidate.summary.clusterSizes if s) < 2:
                    continue
                score = judge.evaluate(candidate.transform(scaled))
                if score > best:
                    best, model = score, candidate
            model = model or fit(2)
        sizes = sorted(enumerate(model.summary.clusterSizes), key=lambda p: (-p[1], p[0]))
    finally:
        scaled.unpersist()
    order = {old: new for new, (old, _) in enumerate(sizes)}
    rename = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    labelled = model.transform(standard.transform(rows.select("*", *values)))
    return labelled.select(*[ref(c) for c in df.columns], rename[F.col("_c")].alias("cluster"))


def cluster_profiles(
    assigned: DataFrame, columns: Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """Per cluster and feature: size, share, mean, distance from the overall mean and whether it stands out.

    ``distinguishing`` marks the (at most five) features half a standard deviation or more away, ranked by that
    distance.
    """
    names = list(columns)
    measures = [F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(names)]
    spread = [F.stddev_samp(ref(c)).alias(f"s{i}") for i, c in enumerate(names)]
    overall = assigned.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.avg(ref(c)).alias(f"g{i}") for i, c in enumerate(names)],
        *spread,
    )
    groups = assigned.groupBy(ref(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), *measures
    )
    # One row per cluster and feature from here on.
    wide = groups.crossJoin(F.broadcast(overall))
    structs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.round(f"m{i}", 4).alias("cluster_mean"),
            F.round(f"g{i}", 4).alias("global_mean"),
            F.when(
                F.col(f"s{i}") >= 1e-9, (F.round(f"m{i}", 4) - F.col(f"g{i}")) / F.col(f"s{i}")
            ).alias("_d"),
        )
        for i, c in enumerate(names)
    ]
    long = wide.select(
        "cluster",
        "size",
        F.round(F.col("size") / F.col("_all") * 100, 1).alias("size_pct"),
        F.inline(F.array(*structs)),
    )
    order = Window.partitionBy("cluster").orderBy(F.desc_nulls_last(F.abs("_d")), "feature")
    ranked = long.withColumn("_rank", F.row_number().over(order))
    out = F.coalesce(F.abs("_d") >= 0.5, F.lit(False))
    return ranked.select(
        "cluster",
        "size",
        "size_pct",
        "feature",
        "cluster_mean",
        "global_mean",
        F.when(out, F.when(F.col("_d") > 0, "above").otherwise("below")).alias("direction"),
        F.when(out, F.round(F.abs("_d"), 2)).alias("magnitude"),
        (out & (F.col("_rank") <= 5)).alias("distinguishing"),
    )


# --- isolation forest -------------------------------------------------------------------------


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _grow(x: np.ndarray, seed: int) -> dict[str, list]:
    """One isolation tree over at most ``TREE_ROWS`` points, as flat node lists.

    The children of a node are neighbours: a row goes to ``left``, or one further when its value is above the
    cut. A leaf leads to itself.
    """
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(x), 2)))
    tree: dict[str, list] = {"feature": [0], "cut": [math.inf], "left": [0], "path": [0.0]}
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        here, rows, depth = waiting.pop()
        points = x[rows]
        open_features = np.array([], dtype=int)
        if depth < limit and len(rows) > 1:
            low, high = points.min(axis=0), points.max(axis=0)
            open_features = np.flatnonzero(high > low)
        if not len(open_features):
            tree["path"][here] = depth + float(_mean_path(len(rows)))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        below = points[:, f] <= cut
        child = len(tree["feature"])
        tree["feature"][here], tree["cut"][here], tree["left"][here] = f, cut, child
        for part in (rows[below], rows[~below]):
            at = len(tree["feature"])
            tree["feature"].append(0)
            tree["cut"].append(math.inf)
            tree["left"].append(at)
            tree["path"].append(0.0)
            waiting.append((at, part, depth + 1))
    return tree


def _mean_depth(x: np.ndarray, forest: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Mean path length of each row over the trees; all rows of a batch take each step together."""
    total = np.zeros(len(x))
    flat = np.ascontiguousarray(x).ravel()
    start = np.arange(len(x)) * x.shape[1]
    for tree in forest:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(tree["depth"]):
            value = flat[start + tree["feature"][at]]
            at = tree["left"][at] + (value > tree["cut"][at])
        total += tree["path"][at]
    return total / len(forest)


def anomaly_scores(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    contamination: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Every row with ``anomaly_score`` 0-100 and ``is_anomaly`` for the ``contamination`` share on top.

    A hundred isolation trees grow from 256-row samples, one task per tree; the finished forest is small (a few
    hundred nodes per tree) and goes to every task for scoring. Missing numbers count as the median.
    """
    contamination = max(0.01, min(0.5, float(contamination)))
    numeric = set(numeric_columns(df))
    wanted = [c for c in columns if c in numeric]
    if not wanted:
        raise ValueError("Anomalies are looked for in numeric columns, and none was given")
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(ref(c)).alias(f"c{i}") for i, c in enumerate(wanted)])
    counts = facts.first()
    features = [c for i, c in enumerate(wanted) if counts[f"c{i}"]]
    if not features:
        raise ValueError("Anomalies are looked for in numeric columns, and none was given")
    long = unpivot_numeric(df, features).where(F.col("value").isNotNull())
    medians = {
        r["column"]: r["m"] for r in group_percentiles(long, ["column"], "value", {"m": 0.5}).collect()
    }
    vector = F.array(*[F.coalesce(ref(c).cast("double"), F.lit(medians[c])) for c in features])
    filled = spread(df).withColumn("_x", vector)

    # Two thinning steps keep the sampled set near 50,000 rows, whatever the table's size.
    def fraction(*salt: Column) -> Column:
        bits = F.xxhash64(*[ref(k) for k in key], *salt).bitwiseAND(F.lit((1 << 52) - 1))
        return bits / F.lit(float(1 << 52))

    pool_rate = min(1.0, 2.0 * TREES * TREE_ROWS / max(counts["n"], 1))
    pool = filled.where(fraction(F.lit(seed)) < pool_rate).select("_x", *[ref(k) for k in key])
    tree_rate = min(1.0, 2.0 * TREE_ROWS / max(counts["n"] * pool_rate, 1))
    # A row leaves copies for the trees that take it alone.
    every = F.sequence(F.lit(0), F.lit(TREES - 1))
    taken = F.filter(every, lambda tree: fraction(F.lit(seed + 1), tree) < tree_rate)
    trees = pool.withColumn("tree", F.explode(taken)).withColumn("_u", fraction(F.lit(seed + 1), F.col("tree")))
    order = Window.partitionBy("tree").orderBy("_u", *[ref(k) for k in key])
    sample = trees.withColumn("_r", F.row_number().over(order))
    sample = sample.where(F.col("_r") <= TREE_ROWS).select("tree", "_x")

    def grow(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = _grow(np.vstack(rows["_x"].to_numpy()), seed + int(key_[0]))
        return pd.DataFrame({name: [values] for name, values in tree.items()})

    schema = "feature array<long>, cut array<double>, left array<long>, path array<double>"
    grown = sample.groupBy("tree").applyInPandas(grow, schema).collect()
    steps = math.ceil(math.log2(TREE_ROWS))
    forest = [{**{n: np.asarray(v) for n, v in row.asDict().items()}, "depth": steps} for row in grown]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = float(_mean_path(min(TREE_ROWS, counts["n"]))) or 1.0

    @F.pandas_udf("double")
    def isolation(batch: pd.Series) -> pd.Series:
        x = np.vstack(batch.to_numpy()) if len(batch) else np.empty((0, len(features)))
        return pd.Series(np.power(2.0, -_mean_depth(x, shared.value) / norm))

    scored = filled.withColumn("_s", isolation("_x"))
    # Only the score column is kept for the limits; the rows are scored once more when they are read.
    narrow = scored.select("_s").persist()
    cut = group_percentiles(narrow, [], "_s", {"_cut": 1.0 - contamination})
    span = narrow.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    limits = span.crossJoin(cut).first()
    narrow.unpersist()
    low, high = limits["_lo"], limits["_hi"]
    width = high - low
    score = F.lit(0.0) if width < 1e-10 else (F.col("_s") - low) / width * 100
    return scored.select(
        *[ref(c) for c in df.columns],
        F.round(score, 1).alias("anomaly_score"),
        (F.col("_s") > limits["_cut"]).alias("is_anomaly"),
    )


def anomalies(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    contamination: float = 0.05,
    n_top: int = 20,
    seed: int = 42,
) -> DataFrame:
    """The ``n_top`` most anomalous rows."""
    scored = anomaly_scores(df, columns, key, contamination, seed)
    return scored.orderBy(F.desc("anomaly_score"), *[ref(k) for k in key]).limit(n_top)
