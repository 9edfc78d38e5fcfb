"""Feed-forward networks: a regressor that averages what tasks learn from their own rows, and a classifier over many rows."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = (100, 50)
BATCH = 200
#: Passes over the rows of an Arrow batch in a round, more where these make too few steps; the step size; rounds without
#: gain that end training.
EPOCHS, STEPS, STEP, PATIENCE = 8, 120, 3e-3, 4
#: The classifier's rows per array operation; Spark's L-BFGS keeps so many corrections and so many values to judge its gain.
BLOCK, CORRECTIONS, RECENT = 1_024, 10, 20


def _cut(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of each layer, as views of one vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _size(layers: list[int]) -> int:
    return sum(a * b + b for a, b in zip(layers, layers[1:], strict=False))


def _forward(x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The output of each layer: rectified sums, the last one as it is."""
    values = [x]
    for k, (w, b) in enumerate(parts):
        x = x @ w + b
        if k < len(parts) - 1:
            x = np.maximum(x, 0)
        values.append(x)
    return values


def _gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> tuple[np.ndarray, float]:
    parts = _cut(weights, layers)
    values = _forward(x, parts)
    off = values[-1] - y[:, None]
    out, back = [], off * (2 / len(y))
    for k in range(len(parts) - 1, -1, -1):
        out.append(np.concatenate([(values[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = (back @ parts[k][0].T) * (values[k] > 0)
    return np.concatenate(out[::-1]), float((off * off).sum())


class _Shared(Params):
    layers = Param(Params._dummy(), "layers", "width of each layer", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "all weights, layer by layer", TypeConverters.toListFloat)
    centre = Param(Params._dummy(), "centre", "mean of each feature and of the label", TypeConverters.toListFloat)
    spread = Param(Params._dummy(), "spread", "deviation of each feature and of the label", TypeConverters.toListFloat)


class NetworkModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction`` to rows with ``features``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers, weights = self.getOrDefault(self.layers), np.array(self.getOrDefault(self.weights))
        centre, spread = (np.array(self.getOrDefault(p)) for p in (self.centre, self.spread))

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            x = (np.vstack(features.to_numpy()) - centre[:-1]) / spread[:-1]
            return pd.Series(_forward(x, _cut(weights, layers))[-1][:, 0] * spread[-1] + centre[-1])

        return dataset.withColumn("prediction", predict(vector_to_array("features")))


class NetworkRegressor(Estimator, _Shared):
    """Rounds of local training: each task takes Adam steps over small batches of its own rows, from the weights it is
    given; weights and moments are averaged by rows, first among groups of tasks, then on the driver, which holds one
    vector per group. Seeded; the result depends on how rows lie in partitions, as the order of any such training does.
    """

    def __init__(self, rounds: int = 25, seed: int = 42, hidden: tuple[int, ...] = HIDDEN) -> None:
        super().__init__()
        self.rounds, self.seed, self.hidden = rounds, seed, hidden

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).where(F.col("y").isNotNull())
        width = rows.select(F.size("x")).first()
        if width is None:
            raise ValueError("The network needs training rows")
        n = width[0]
        each = [F.get("x", F.lit(i)) for i in range(n)] + [F.col("y")]
        facts = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
        centre, spread = np.array(facts[1 : n + 2], float), np.array(facts[n + 2 :], float)
        spread[~(spread > 0)] = 1.0
        layers, rng = [n, *self.hidden, 1], np.random.default_rng(self.seed)
        size = _size(layers)
        state = np.zeros(3 * size)
        for w, _ in _cut(state[:size], layers):
            w[:] = rng.normal(0, math.sqrt(2 / len(w)), w.shape)
        best, kept, stale, seed = math.inf, state[:size].copy(), 0, self.seed
        tasks = rows.rdd.getNumPartitions()

        for number in range(self.rounds):
            shared = rows.sparkSession.sparkContext.broadcast(state)

            def learn(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
                own = shared.value.copy()
                weights, first, second = own[:size], own[size : 2 * size], own[2 * size :]
                count = loss = 0
                steps = 100 * number
                order = np.random.default_rng(seed + number)
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = np.asarray(batch.column(0).flatten(), float).reshape(-1, n)
                    x, y = (x - centre[:-1]) / spread[:-1], (np.asarray(batch.column(1), float) - centre[-1]) / spread[-1]
                    count += len(y)
                    loss += float(((_forward(x, _cut(weights, layers))[-1][:, 0] - y) ** 2).sum())
                    for _ in range(max(EPOCHS, math.ceil(STEPS * BATCH / max(len(y), BATCH)))):
                        at = order.permutation(len(y))
                        for k in range(0, len(y), BATCH):
                            part = at[k : k + BATCH]
                            gradient, _ = _gradient(x[part], y[part], weights, layers)
                            steps += 1
                            first += 0.1 * (gradient - first)
                            second += 0.001 * (gradient * gradient - second)
                            rate = STEP * math.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                            weights -= rate * first / (np.sqrt(second) + 1e-8)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([loss]), pa.array([own.tolist()])], names=["n", "loss", "state"])

            def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, loss, mean = 0, 0.0, np.zeros(3 * size)
                for batch in batches:
                    for k, one, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        total, loss = total + k, loss + one
                        mean += (np.array(own) - mean) * (k / total)
                if total:
                    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([loss]), pa.array([mean.tolist()])], names=["n", "loss", "state"])

            schema = "n long, loss double, state array<double>"
            learnt = rows.mapInArrow(learn, schema)
            if tasks > 16:
                learnt = learnt.repartition(math.isqrt(tasks)).mapInArrow(averaged, schema)
            found = learnt.collect()
            total = sum(r["n"] for r in found)
            loss = sum(r["loss"] for r in found) / total
            if loss < best * (1 - 1e-3):
                best, stale, kept = loss, 0, state[:size].copy()
            else:
                stale += 1
            state = sum(np.array(r["state"]) * (r["n"] / total) for r in found)
            shared.unpersist()
            if stale >= PATIENCE:
                break
        else:
            kept = state[:size]
        model = NetworkModel()
        return model._set(layers=layers, weights=kept.tolist(), centre=centre.tolist(), spread=spread.tolist())


class NetworkClassifier(Estimator):
    """Trains a ``MultilayerPerceptronClassifier`` over many rows: its own start, loss, L-BFGS steps and stopping rules, with
    the gradient of each task's rows taken in blocks by array operations and summed in a tree.
    """

    def __init__(self, net: MultilayerPerceptronClassifier) -> None:
        super().__init__()
        self.net = net

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        net, layers, n = self.net, self.net.getLayers(), self.net.getLayers()[0]
        one = dataset.limit(1)
        # Without iterations the library hands back the weights it begins with.
        start = net.copy({net.maxIter: 0}).fit(one).weights.toArray()
        rows = dataset.select(vector_to_array(net.getFeaturesCol()).alias("x"), F.col(net.getLabelCol()).cast("double").alias("y"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = np.asarray(batch.column(0).flatten(), float), np.asarray(batch.column(1), float).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

        blocks = rows.mapInArrow(pack, "x binary, y binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        context = dataset.sparkSession.sparkContext

        def cost(weights: np.ndarray) -> tuple[float, np.ndarray]:
            shared = context.broadcast(weights)

            def summed(part: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[int, float, np.ndarray]]:
                own, count, loss, gradient = _cut(shared.value, layers), 0, 0.0, np.zeros(len(shared.value))
                for raw, marks in part:
                    x, y = np.frombuffer(raw).reshape(-1, n), np.frombuffer(marks, np.int64)
                    for k in range(0, len(y), BLOCK):
                        more = _class_gradient(x[k : k + BLOCK], y[k : k + BLOCK], own, gradient, layers)
                        count, loss = count + len(y[k : k + BLOCK]), loss + more
                yield count, loss, gradient

            count, loss, gradient = blocks.mapPartitions(summed).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            shared.destroy()
            return loss / count, gradient / count

        try:
            found = minimised(cost, start, net.getMaxIter(), net.getTol())
        finally:
            blocks.unpersist()
        return net.copy({net.maxIter: 0, net.initialWeights: Vectors.dense(found)}).fit(one)


def _class_gradient(
    x: np.ndarray, y: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray, layers: list[int]
) -> float:
    """Cross entropy of the rows, summed; its gradient is added to ``gradient``. Logistic layers, softmax at the end."""
    values = [x]
    for k, (w, b) in enumerate(parts):
        z = values[-1] @ w
        z += b
        if k < len(parts) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            values.append(z)
    z -= z.max(axis=1, keepdims=True)
    at = np.arange(len(y))
    own = z[at, y]
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    loss = float((np.log(total[:, 0]) - own).sum())
    z /= total
    z[at, y] -= 1
    sums = _cut(gradient, layers)
    for k in range(len(parts) - 1, -1, -1):
        sums[k][0][...] += values[k].T @ z
        sums[k][1][...] += z.sum(axis=0)
        if k:
            z = z @ parts[k][0].T
            z *= values[k]
            np.subtract(1, values[k], out=values[k])
            z *= values[k]
    return loss


def minimised(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tol: float) -> np.ndarray:
    """L-BFGS with a strong Wolfe line search and the stopping rules of Spark's optimiser: ``most`` steps, a gradient or a gain
    over the last 20 steps within ``tol``, or two failed searches in a row."""
    value, slope = cost(x)
    first, last, pairs, failed = value, deque([value], RECENT), deque(maxlen=CORRECTIONS), False
    for step in range(most):
        if np.linalg.norm(slope) <= max(tol * abs(value), 1e-8):
            break
        along, used = -slope, []
        for s, g in reversed(pairs):
            used.append(s @ along / (s @ g))
            along = along - used[-1] * g
        if pairs:
            along = along * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (s, g), a in zip(pairs, reversed(used), strict=True):
            along = along + (a - g @ along / (s @ g)) * s
        found = _searched(cost, x, value, slope, along, 1.0 if step else 1 / np.linalg.norm(along))
        if found is None:
            if failed or not pairs:
                break
            failed = True
            pairs.clear()
            continue
        failed = False
        t, value, after = found
        if t * along @ (after - slope) > 0:
            pairs.append((t * along, after - slope))
        x, slope = x + t * along, after
        last.append(value)
        if abs(value - max(last)) <= tol * abs(first):
            break
    return x


def _searched(
    cost: Callable, x: np.ndarray, value: float, slope: np.ndarray, along: np.ndarray, t: float
) -> tuple[float, float, np.ndarray] | None:
    """Step, value and gradient that meet the strong Wolfe conditions; None when ten brackets or ten cuts find none."""
    down = slope @ along
    if down > 0:
        return None

    def at(t: float) -> tuple[float, float, float, np.ndarray]:
        f, g = cost(x + t * along)
        return t, f, g @ along, g

    def zoom(low: tuple, high: tuple) -> tuple[float, float, np.ndarray] | None:
        for _ in range(10):
            c = at(_between(*sorted((low, high), key=lambda p: p[0])))
            if c[1] > value + 1e-4 * c[0] * down or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(down):
                return c[0], c[1], c[3]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    low = (0.0, value, down, slope)
    for i in range(10):
        c = at(t)
        if not (math.isfinite(c[1]) and math.isfinite(c[2])):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * down or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(down):
            return c[0], c[1], c[3]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through both ends, a tenth of their distance away from either."""
    width = right[0] - left[0]
    d1 = left[2] + right[2] + 3 * (left[1] - right[1]) / width
    root = d1 * d1 - left[2] * right[2]
    low, high = left[0] + 0.1 * width, left[0] + 0.9 * width
    if root < 0:
        return (low + high) / 2
    d2 = math.sqrt(root)
    gap = right[2] - left[2] + 2 * d2
    return (low + high) / 2 if gap == 0 else min(max(right[0] - width * (right[2] + d2 - d1) / gap, low), high)
