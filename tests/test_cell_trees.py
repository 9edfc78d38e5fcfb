"""Trees grown from sums per cell are those that the library grows from the rows, however many rows, levels and rounds."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from framewise.operators import ml, trees


def vectors(df, *names):
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


@pytest.fixture(scope="module")
def rows(spark):
    """Three features of 31, 7 and 5 values; the label depends on all, and rows of one cell differ."""
    df = spark.range(3_000, numPartitions=3).selectExpr(
        "id", "CAST(id % 31 AS DOUBLE) AS a", "CAST(id DIV 31 % 7 AS DOUBLE) AS b", "CAST(id % 5 AS DOUBLE) AS c",
        "SIN(id % 31) * 9 + 2 * (id DIV 31 % 7) + IF(id % 5 = 3, 4, 0) + id % 13 / 7 + 1000 AS label"
    )
    return vectors(df, "a", "b", "c").persist()


def r2(model, rows):
    return ml._measured(model, rows, "regression")["r2"]


@pytest.mark.parametrize("algorithm", ["gradient_boosting_regressor", "random_forest_regressor"])
def test_jobs_do_not_grow_with_the_trees(spark, rows, monkeypatch, algorithm):
    monkeypatch.setattr(ml, "DEALT_ROWS", 10)
    stats = ml.FeatureStats(["a", "b", "c"], "label", "regression")
    jobs = []
    for number in (4, 12):
        spark.sparkContext.setJobGroup(f"{algorithm} {number}", "")
        ml._fit(rows, stats, algorithm, {"n_estimators": number, "max_depth": number - 2})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{algorithm} {number}")))
    spark.sparkContext._jsc.clearJobGroup()
    # Reading the trees back can take a job or two more; a job per round or level would add eight and more.
    assert 0 < jobs[0] and abs(jobs[1] - jobs[0]) <= 3


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_boosting_is_the_library_s(rows, depth):
    boost = GBTRegressor(maxIter=15, maxDepth=depth, stepSize=0.3, seed=42)
    library, ours = boost.fit(rows), trees.CellTrees(boost).fit(rows)
    assert ours.getNumTrees == 15 and ours.treeWeights == library.treeWeights
    both = ours.transform(rows).withColumnRenamed("prediction", "ours")
    far = library.transform(both).agg(F.max(F.abs(F.col("ours") - F.col("prediction")))).first()[0]
    assert far < 1e-6
    if depth < 30:  # splits without any gain but for rounding weigh nothing, yet are counted
        assert ours.totalNumNodes == library.totalNumNodes
    assert ours.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), abs=1e-6)


def test_forest_is_like_the_library_s(rows):
    found = {"library": [], "cells": []}
    for seed in range(3):
        forest = RandomForestRegressor(numTrees=40, maxDepth=30, seed=seed)
        for name, model in (("library", forest.fit(rows)), ("cells", trees.CellTrees(forest).fit(rows))):
            assert model.getNumTrees == 40 and model.numFeatures == 3
            found[name].append((r2(model, rows), model.totalNumNodes, *model.featureImportances.toArray()))
    a, b = (np.mean(found[name], axis=0) for name in ("library", "cells"))
    assert a[0] == pytest.approx(b[0], abs=0.1) and a[1] == pytest.approx(b[1], rel=0.25) and a[2:] == pytest.approx(b[2:], abs=0.1)


def test_bootstrap_draws_whole_rows(rows):
    sums = trees.cell_sums(rows.select(vector_to_array("features").alias("x"), F.col("label").alias("y")), [np.array([15.5]), np.zeros(0), np.zeros(0)], 50, 7, 0.0)
    weights = np.array([r.weight for r in sums.groupBy("tree").agg(F.sum("weight").alias("weight")).collect()])
    assert len(weights) == 50 and (weights == weights.round()).all() and len(set(weights)) > 20
    # Poisson numbers: mean 3,000 a tree, deviation the root of it.
    assert abs(weights.mean() - 3_000) < 40 and 35 < weights.std() < 80
    draws = trees._bootstrap(np.random.Generator(np.random.SFC64(1)), 200_000)
    assert np.bincount(draws.astype(int))[:4] / 200_000 == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)


def test_stored_forest_scores_the_same(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(ml, "DEALT_ROWS", 10)
    stats = ml.FeatureStats(["a", "b", "c"], "label", "regression")
    model = ml._fit(rows, stats, "random_forest_regressor", {"n_estimators": 6})
    model.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert type(back.stages[0]).__name__ == "RandomForestRegressionModel" and isinstance(model.stages[0], trees.CellForestModel)
    far = back.transform(model.transform(rows).withColumnRenamed("prediction", "p")).agg(F.max(F.abs(F.col("p") - F.col("prediction"))))
    assert far.first()[0] < 1e-9


def test_cuts(spark):
    df = spark.range(4_000).selectExpr(
        "CAST(id % 3 AS DOUBLE) AS few", "CAST(id AS DOUBLE) AS many", "CAST(IF(id % 10 = 0, id, 0) AS DOUBLE) AS tied", "7.0D AS one", "CAST(id AS DOUBLE) AS y"
    )
    found, centre = trees.cuts(df.select(F.array("few", "many", "tied", "one").alias("x"), "y"), 8, 1 << 16)
    assert centre == 1_999.5 and found[0].tolist() == [0.5, 1.5] and found[3].tolist() == []
    assert len(found[1]) == 7 and found[1] == pytest.approx(np.arange(1, 8) * 500, abs=20)
    # Nine rows in ten hold one value: the others still get all cuts that are left.
    assert len(found[2]) == 7 and found[2][0] == 0.0 and found[2][-1] > 3_000
    assert trees.cuts(df.select(F.array("many", "tied").alias("x"), "y"), 8, 63) is None


def test_what_is_left_to_the_library(spark, rows):
    forest = RandomForestRegressor(numTrees=3, seed=1)
    gaps = rows.withColumn("label", F.when(F.col("a") > 3, F.col("label")))
    with pytest.raises(Exception, match="MUST NOT be Null"):
        trees.CellTrees(forest).fit(gaps)
    for est in (RandomForestRegressor(numTrees=1), GBTRegressor(maxIter=3, subsamplingRate=0.5)):
        assert not isinstance(trees.CellTrees(est).fit(rows), trees._OverCells)
    wide = vectors(spark.range(500).selectExpr(*[f"CAST(hash(id, {i}) AS DOUBLE) AS x{i}" for i in range(6)], "CAST(id AS DOUBLE) AS label"), *[f"x{i}" for i in range(6)])
    assert not isinstance(trees.CellTrees(forest).fit(wide), trees._OverCells)


def test_many_rows_train_several(spark, large_plans, tmp_path, monkeypatch):
    monkeypatch.setattr(ml, "DEALT_ROWS", 10)
    spark.range(4_000).selectExpr("id", "id % 97 / 7 AS x", "CAST(id % 11 AS STRING) AS c", "3 * (id % 97) + IF(id % 11 = 4, 50, 0) AS y").write.parquet(str(tmp_path / "t"))
    models = ml.train_many(
        spark.read.parquet(str(tmp_path / "t")), ["linear_regression", "random_forest_regressor", "lightgbm_regressor"], ["x", "c"], "y", ["id"],
        params={"n_estimators": 20},
    )
    assert ["error" in m.metrics for m in models] == [False] * 3
    assert isinstance(models[1].model.stages[0], trees.CellForestModel) and isinstance(models[2].model.stages[0], trees.CellBoostingModel)
    assert models[2].metrics["r2"] > 0.9 and all(m.stats.residual_std > 0 and m.metrics["train_size"] + m.metrics["test_size"] == 4_000 for m in models)
