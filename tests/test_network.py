import math

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from framewise.operators import ml, network, scoring


@pytest.fixture(scope="module")
def waves(spark):
    rows = [(i, (i * 37 % 600) / 100, (i * 91 % 500) / 100, "ab"[i % 2]) for i in range(2_400)]
    rows = [(i, a, b, c, math.sin(a) * b + (2.0 if c == "a" else 0.0)) for i, a, b, c in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double").repartition(3)


def test_network_learns_a_smooth_target(spark, waves, tmp_path):
    trained = ml.train(waves, "mlp_regressor", ["a", "b", "c"], "y", ["id"])
    assert trained.metrics["r2"] > 0.95
    scoring.save_model(trained, str(tmp_path / "model"))
    again = scoring.load_model(spark, str(tmp_path / "model"))
    one, two = ([r["prediction"] for r in scoring.score_batch(waves.orderBy("id"), m).limit(50).collect()] for m in (trained, again))
    assert one == two
    assert set(ml.importance_map(trained)) == {"a", "b", "c"}


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    layers = [3, 7, 4, 1]
    w, x, y = rng.normal(size=network._size(layers)), rng.normal(size=(20, 3)), rng.normal(size=20)
    gradient, _ = network._gradient(x, y, w, layers)
    loss = lambda v: ((network._forward(x, network._cut(v, layers))[-1][:, 0] - y) ** 2).mean()
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert abs((loss(w + step) - loss(w - step)) / 2e-6 - gradient[k]) < 1e-5


def test_network_of_constant_columns_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1.0, 5.0) for i in range(40)], "id long, a double, y double")
    trained = ml.train(df, "mlp_regressor", ["a"], "y", ["id"], params={"rounds": 2})
    assert {round(r["prediction"], 2) for r in scoring.score_batch(df, trained).collect()} == {5.0}


def test_classifier_over_many_rows_takes_the_steps_of_the_library(spark):
    # One partition of whole blocks: the library gives the rows of a last, shorter block more weight.
    points = [((i * 37 % 512) / 170 - 1.5, (i * 91 % 512) / 170 - 1.5) for i in range(512)]
    rows = [(Vectors.dense(p), float(p[0] ** 2 + p[1] ** 2 < 1.2)) for p in points]
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(1).persist()
    for steps in (0, 1, 6):
        net = MultilayerPerceptronClassifier(layers=[2, 20, 10, 2], maxIter=steps, seed=42)
        one, two = (e.fit(df).weights.toArray() for e in (net, network.NetworkClassifier(net)))
        assert np.allclose(one, two, atol=1e-8)
    df.unpersist()


def test_only_many_rows_train_by_array_operations(spark, monkeypatch):
    few, many = (ml.estimator("neural_network_classifier", 2, 2, {}, n).getStages()[-1] for n in (ml.DEALT_ROWS, ml.DEALT_ROWS + 1))
    assert isinstance(few, MultilayerPerceptronClassifier) and isinstance(many, network.NetworkClassifier)
    monkeypatch.setattr(ml, "DEALT_ROWS", 100)
    df = spark.range(400).selectExpr("id", "id * 37 % 400 / 100 a", "if(id * 37 % 400 > 200, 'in', 'out') y")
    trained = ml.train(df, "neural_network_classifier", ["a"], "y", ["id"], "classification", {"max_iter": 15})
    assert trained.metrics["accuracy"] > 0.9 and trained.metrics["train_size"] + trained.metrics["test_size"] == 400


def test_minimum_of_a_bent_valley():
    def cost(x):
        a, b = x
        return 100 * (b - a * a) ** 2 + (1 - a) ** 2, np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])

    assert np.allclose(network.minimised(cost, np.array([-1.2, 1.0]), 200, 1e-12), [1, 1], atol=1e-4)
