"""Regression forests and boosted trees over many rows, grown from sums per cell instead of from the rows.

Spark's trees compare a feature with at most ``maxBins`` - 1 cuts. Rows between the same cuts of all features (a cell) go the
same way in every tree, and a split is judged by the weight and the label sum of either side. One reading of the rows therefore
gives all that any tree needs, where the library reads them once per level and round. Bootstrap weights, features tried at a
node, stopping rules and residuals are the library's; the results are the library's models, which also know their prediction
of each cell.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.scale import shared_folder

#: Cells of all features, and cells times trees, up to which sums are kept; beyond, the library grows the trees.
CELLS, SUMS = 1 << 16, 1 << 22
#: Rows of an array operation, and rows of a batch that a task hands on.
BLOCK, OUT_ROWS = 1 << 16, 100_000
#: Ranks of the estimated quantiles are off by one in so many of the rows; merging the estimates takes one task.
ACCURACY = 1_000
#: A gain of a smaller share of the label's variance is rounding.
ROUNDING = 1e-20
#: The chances of 0, 1, ... of a Poisson number with mean 1, added up, in steps of 2^-32.
_DRAWS = [round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(20)]
_DRAWS = np.array([x for x in _DRAWS if x < 2**32], np.uint32)

SUM_SCHEMA = "tree int, cell int, weight double, total double, squares double"
NODE_SCHEMA = (
    "tree int, id int, prediction double, impurity double, weight double, total double, squares double, gain double, "
    "left_child int, right_child int, feature int, cut double, of_cells array<double>"
)


class _OverCells:
    """A model of the library that looks up its prediction of a row's cell instead of walking all trees."""

    bounds: list[np.ndarray]
    of_cells: np.ndarray

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLeafCol():
            return super()._transform(dataset)
        bounds, of_cells = self.bounds, self.of_cells

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(of_cells[_cells_of(x, bounds)])

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))


class CellForestModel(_OverCells, RandomForestRegressionModel):
    """Is stored and read again as the library's model."""


class CellBoostingModel(_OverCells, GBTRegressionModel):
    """Is stored and read again as the library's model."""


class CellTrees(Estimator):
    """Fits a forest or boosting regressor of the library from the sums per cell.

    Labels or features that the library refuses, subsamples, single trees and features of too many cells are left to it.
    """

    def __init__(self, native: RandomForestRegressor | GBTRegressor) -> None:
        super().__init__()
        self.native = native

    def _fit(self, dataset: DataFrame) -> Model:
        native, forest = self.native, isinstance(self.native, RandomForestRegressor)
        trees = native.getNumTrees() if forest else native.getMaxIter()
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        cells = CELLS if native.getSubsamplingRate() == 1.0 and trees > 1 else 0
        found = cuts(rows, native.getMaxBins(), min(cells, SUMS // trees if forest else cells))
        if found is None:
            return native.fit(dataset)
        bounds, centre = found
        sums = cell_sums(rows, bounds, trees if forest else 0, native.getSeed(), centre)
        grown = _forest(sums, bounds, native, trees, centre) if forest else _boosted(sums, bounds, native, centre)
        return _model(grown, native, bounds, trees)


def cuts(rows: DataFrame, bins: int, most: int) -> tuple[list[np.ndarray], float] | None:
    """The cuts of each feature, and the mean label; None when there are over ``most`` cells or values that are no numbers.

    A feature of at most ``bins`` values is cut half-way between them, any other one at its quantiles. What values that hold
    several quantiles leave over is cut at the quantiles of the other rows.
    """
    width = rows.select(F.size("x")).first()[0]
    if most < 2 or width < 1:
        return None
    each = [F.get("x", F.lit(i)) for i in range(width)]

    def quantiles(column: Column, number: int) -> Column:
        return F.percentile_approx(column, F.array(*[F.lit(k / (number + 1)) for k in range(1, number + 1)]), ACCURACY)

    facts = rows.agg(
        F.struct(F.avg("y"), F.min("y"), F.max("y"), F.count("y"), F.count(F.lit(1))).alias("label"),
        *[F.struct(F.min(c), F.max(c), F.approx_count_distinct(c, 0.05), quantiles(c, bins - 1)).alias(f"f{i}") for i, c in enumerate(each)],
    ).first()
    centre, *ends, labelled, n = facts["label"]
    if labelled < n or not all(np.isfinite(v) for v in [*ends, *[v for f in facts[1:] for v in f[:2]]]):
        return None
    bounds = [np.zeros(0)] * width
    found = {i: f[3] for i, f in enumerate(facts[1:])}
    # Far beyond the estimate's error; the values themselves are only collected where there can be few of them.
    if few := [i for i, f in enumerate(facts[1:]) if f[2] <= 2 * bins]:
        for i, values in zip(few, rows.agg(*[F.collect_set(each[i]) for i in few]).first(), strict=True):
            if len(values) <= bins:
                own = np.unique(values)
                bounds[i] = (own[:-1] + own[1:]) / 2
                del found[i]
    tied: dict[int, set[float]] = {i: set() for i in found}
    while found:
        for i, places in found.items():
            at, times = np.unique(places, return_counts=True)
            before, bounds[i] = len(bounds[i]), np.union1d(bounds[i], at[at < facts[1 + i][1]])
            tied[i] |= set(at[times > 1].tolist())
            if not tied[i] or len(bounds[i]) in (before, bins - 1):
                del tied[i]
        rest = [F.when(~each[i].isin(list(values)), each[i]) for i, values in tied.items()]
        left = [quantiles(c, bins - 1 - len(bounds[i])) for i, c in zip(tied, rest, strict=True)]
        row = rows.agg(*left).first() if left else []
        found = {i: places for i, places in zip(tied, row, strict=True) if places is not None}
        tied = {i: tied[i] for i in found}
    return (bounds, float(centre)) if math.prod(len(b) + 1 for b in bounds) <= most else None


def _bootstrap(rng: np.random.Generator, n: int) -> np.ndarray:
    """How often each row is drawn: Poisson numbers with mean 1."""
    spots = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    out = np.zeros(n, np.uint8)
    for x in _DRAWS:
        out += spots >= x
    return out.astype(float)


def cell_sums(rows: DataFrame, bounds: list[np.ndarray], trees: int, seed: int, centre: float) -> DataFrame:
    """Weight, sum and squares of the labels (less ``centre``) of each cell of each tree, from one reading of the rows.

    Each tree draws its own bootstrap; without ``trees`` each row counts once, as tree 0.
    """
    n_cells, _ = _steps(bounds)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.SFC64([seed & (2**64 - 1), TaskContext.get().partitionId()]))
        out = np.zeros((max(trees, 1), 3, n_cells))

        def add(cell: np.ndarray, y: np.ndarray) -> None:
            order = np.argsort(cell, kind="stable")
            cell, y = cell[order], y[order]
            squares = y * y
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            at = cell[starts]
            for t in range(len(out)):
                w = _bootstrap(rng, len(y)) if trees else np.ones(len(y))
                for k, values in enumerate((w, w * y, w * squares)):
                    out[t, k, at] += np.add.reduceat(values, starts)

        held, n = [], 0
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False) - centre
            held.append((_cells_of(batch.column(0), bounds), y))
            n += len(y)
            if n >= BLOCK:
                add(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            add(*map(np.concatenate, zip(*held, strict=True)))
        tree, cell = np.nonzero(out[:, 0])
        for a in range(0, len(tree), OUT_ROWS):
            t, c = tree[a : a + OUT_ROWS], cell[a : a + OUT_ROWS]
            columns = [t.astype(np.int32), c.astype(np.int32), *[out[t, k, c] for k in range(3)]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["tree", "cell", "weight", "total", "squares"])

    parts = rows.mapInArrow(sums, SUM_SCHEMA)
    return parts.groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in ("weight", "total", "squares")])


def _steps(bounds: list[np.ndarray]) -> tuple[int, list[int]]:
    """The number of cells, and how far apart two neighbours along each feature are numbered."""
    steps, cells = [], 1
    for cut in bounds:
        steps.append(cells)
        cells *= len(cut) + 1
    return cells, steps


def _cells_of(x: pa.Array, bounds: list[np.ndarray]) -> np.ndarray:
    """The cell of each row's features."""
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    cell = np.zeros(len(x), np.int32)
    for i, (cut, step) in enumerate(zip(bounds, _steps(bounds)[1], strict=True)):
        cell += (np.searchsorted(cut, x[:, i]) * step).astype(np.int32)
    return cell


def _places(bounds: list[np.ndarray]) -> np.ndarray:
    """The bin of each feature of each cell."""
    n_cells, steps = _steps(bounds)
    return np.stack([np.arange(n_cells) // step % (len(cut) + 1) for cut, step in zip(bounds, steps, strict=True)], axis=1)


def _dense(cells: pd.DataFrame, n_cells: int) -> np.ndarray:
    """Weight, sum and squares of every cell, of those without rows too."""
    out = np.zeros((n_cells, 3))
    out[cells["cell"]] = cells[["weight", "total", "squares"]]
    return out


def grow(
    places: np.ndarray, sums: np.ndarray, bounds: list[np.ndarray], depth: int, least: int = 1, tried: int = 0, rng: Any = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A regression tree over cells, level by level, and the leaf of each cell.

    ``sums`` has a row of weight, label sum and squares per cell. A node tries ``tried`` features drawn at random, or all; it
    stays a leaf at the given depth, when no cut leaves weight ``least`` on both sides, and when none gains.
    """
    m, d = places.shape
    bins = max(len(c) for c in bounds) + 1
    leaf = np.zeros(m, np.int64)
    whole = sums.sum(axis=0)
    floor = ROUNDING * max(whole[2] / whole[0] - (whole[1] / whole[0]) ** 2, 0.0)
    levels, first, count = [], 0, 1
    for level in range(depth + 1):
        local = leaf - first
        live = np.flatnonzero(local >= 0)
        local = local[live]
        of = np.stack([np.bincount(local, sums[live, k], count) for k in range(3)])
        node = {"gain": np.full(count, -1.0), "feature": np.full(count, -1), "bin": np.full(count, -1), "left": np.full(count, -1)}
        levels.append({"weight": of[0], "total": of[1], "squares": of[2], **node})
        if level == depth or bins < 2:
            break
        if 0 < tried < d:
            choice = rng.random((count, d)).argsort(axis=1)[:, :tried]
        else:
            choice = np.tile(np.arange(d), (count, 1))
        for features in choice.T:
            flat = local * bins + places[live, features[local]]
            w, s = (np.bincount(flat, sums[live, k], count * bins).reshape(count, bins).cumsum(axis=1)[:, :-1] for k in range(2))
            rest, other = of[0][:, None] - w, of[1][:, None] - s
            with np.errstate(divide="ignore", invalid="ignore"):
                # The variance that the two sides' means explain.
                gain = (s / w - other / rest) ** 2 * w * rest / of[0][:, None] ** 2
            gain[(w < least) | (rest < least)] = -1.0
            best = gain.argmax(axis=1)
            top = gain[np.arange(count), best]
            better = (top > floor) & (top > node["gain"])
            for name, value in (("gain", top), ("feature", features), ("bin", best)):
                node[name][better] = value[better]
        split = node["feature"] >= 0
        if not split.any():
            break
        after = first + count
        node["left"][split] = after + 2 * np.arange(split.sum())
        moved = split[local]
        at, local = live[moved], local[moved]
        right = places[at, node["feature"][local]] > node["bin"][local]
        leaf[at] = node["left"][local] + right
        first, count = after, 2 * int(split.sum())
    return {name: np.concatenate([x[name] for x in levels]) for name in levels[0]}, leaf


def _table(tree: int, nodes: dict[str, np.ndarray], bounds: list[np.ndarray], centre: float) -> pd.DataFrame:
    """A tree's nodes in the form of ``NODE_SCHEMA``."""
    w, s, q = nodes["weight"], nodes["total"], nodes["squares"]
    mean, inner = s / w, nodes["left"] >= 0
    cut = [bounds[f][b] if f >= 0 else math.nan for f, b in zip(nodes["feature"], nodes["bin"], strict=True)]
    return pd.DataFrame(
        {
            "tree": tree,
            "id": np.arange(len(w)),
            "prediction": centre + mean,
            "impurity": np.maximum(q / w - mean**2, 0.0),
            "weight": w,
            "total": s + centre * w,
            "squares": q + 2 * centre * s + centre**2 * w,
            "gain": nodes["gain"],
            "left_child": nodes["left"],
            "right_child": np.where(inner, nodes["left"] + 1, -1),
            "feature": nodes["feature"],
            "cut": cut,
        }
    )


def _forest(sums: DataFrame, bounds: list[np.ndarray], native: RandomForestRegressor, trees: int, centre: float) -> DataFrame:
    """The nodes of all trees, one task per tree, and each tree's predictions. A node tries a third of the features, as in the library."""
    depth, least, seed = native.getMaxDepth(), native.getMinInstancesPerNode(), native.getSeed()
    tried = math.ceil(len(bounds) / 3)

    def one(cells: pd.DataFrame) -> pd.DataFrame:
        tree, places = int(cells["tree"].iloc[0]), _places(bounds)
        rng = np.random.default_rng([seed & (2**64 - 1), tree])
        nodes, leaf = grow(places, _dense(cells, len(places)), bounds, depth, least, tried, rng)
        table = _table(tree, nodes, bounds, centre)
        table["of_cells"] = [table["prediction"].to_numpy()[leaf], *[None] * (len(table) - 1)]
        return table

    return sums.repartition(trees, "tree").groupBy("tree").applyInPandas(one, NODE_SCHEMA)


def _boosted(sums: DataFrame, bounds: list[np.ndarray], native: GBTRegressor, centre: float) -> DataFrame:
    """The nodes of all rounds, and their predictions together. A round's labels are the negative gradients of the squared
    error, twice the residuals.
    """
    places = _places(bounds)
    start = _dense(sums.toPandas(), len(places))
    w, s, q = start.T
    depth, least = native.getMaxDepth(), native.getMinInstancesPerNode()
    tables, known = [], np.zeros(len(w))
    for number in range(native.getMaxIter()):
        now = np.stack([w, 2 * (s - known * w), 4 * (q - 2 * known * s + known**2 * w)], axis=1) if number else start
        nodes, leaf = grow(places, now, bounds, depth, least)
        tables.append(_table(number, nodes, bounds, 0.0 if number else centre))
        known = known + (nodes["total"] / nodes["weight"])[leaf] * (native.getStepSize() if number else 1.0)
    table = pd.concat(tables, ignore_index=True)
    table["of_cells"] = [known + centre, *[None] * (len(table) - 1)]
    return sums.sparkSession.createDataFrame(table, NODE_SCHEMA)


def _described(kind: str, uid: str, spark_version: str, params: dict[str, Any], defaults: dict[str, Any], **more: Any) -> str:
    head = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark_version}
    return json.dumps({**head, "uid": uid, "paramMap": params, "defaultParamMap": defaults, **more})


def _model(grown: DataFrame, native: RandomForestRegressor | GBTRegressor, bounds: list[np.ndarray], trees: int) -> Model:
    """The library's model of these nodes, by way of the form in which it stores its models."""
    spark, forest = grown.sparkSession, isinstance(native, RandomForestRegressor)
    kind = RandomForestRegressionModel if forest else GBTRegressionModel
    params = {p.name: native.getOrDefault(p) for p in native.params if native.isSet(p)}
    defaults = {p.name: native._defaultParamMap[p] for p in native.params if native.hasDefault(p)}
    of_tree = ("cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
               "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", "impurity")
    path = shared_folder(spark)
    inner = F.col("left_child") >= 0
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(inner, F.array("cut")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    node = F.struct(
        "id", "prediction", "impurity", F.array("weight", "total", "squares").alias("impurityStats"),
        F.col("weight").cast("long").alias("rawCount"), "gain", F.col("left_child").alias("leftChild"),
        F.col("right_child").alias("rightChild"), split.alias("split"),
    )
    own = [{k: v for k, v in x.items() if k in of_tree} for x in (params, defaults)]
    heads = [
        (t, _described("DecisionTreeRegressionModel", f"{native.uid}_{t}", spark.version, *own), native.getStepSize() if t and not forest else 1.0)
        for t in range(trees)
    ]
    head = _described(kind.__name__, native.uid, spark.version, params, defaults, numFeatures=len(bounds), numTrees=trees)
    try:
        # Grown once: the nodes and the predictions of the cells must come from the same bootstrap.
        grown.write.parquet(f"{path}/grown")
        nodes = spark.read.schema(grown.schema).parquet(f"{path}/grown")
        nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
        spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        model = (CellForestModel if forest else CellBoostingModel)(kind.read()._jread.load(path))
        model._transfer_params_from_java()
        parts = nodes.where(F.col("of_cells").isNotNull()).select("tree", "of_cells").orderBy("tree").toLocalIterator()
        model.bounds, model.of_cells = bounds, sum(np.array(r["of_cells"]) for r in parts) / (trees if forest else 1)
        return model
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
