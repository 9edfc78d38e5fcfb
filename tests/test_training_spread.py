"""Rows that training reads again and again lie in as many tasks as they need, whatever file they come from."""

import pytest
from pyspark.sql import functions as F

from framewise.functions import scale
from framewise.operators import ml, mining


def one_split(spark, folder, n):
    rows = spark.range(n).select(
        "id", (F.col("id") % 97 / 7).alias("x"), (F.col("id") % 11).cast("string").alias("c"), F.lit("wide").alias("unused")
    )
    rows.withColumn("y", 3 * F.col("x") + 1).coalesce(1).write.parquet(str(folder / "rows"))
    return spark.read.parquet(str(folder / "rows"))


def test_known_number_of_rows_sets_the_tasks(spark, large_plans, tmp_path, monkeypatch):
    rows = one_split(spark, tmp_path, 1_000)
    cores = spark.sparkContext.defaultParallelism
    assert scale.spread(rows).rdd.getNumPartitions() == 1
    assert scale.spread(rows, 1_000).rdd.getNumPartitions() == cores
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    assert scale.spread(rows, 1_000).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("kind", ["train", "clusters"])
def test_training_uses_all_cores(spark, large_plans, tmp_path, monkeypatch, kind):
    rows = one_split(spark, tmp_path, 1_000)
    monkeypatch.setattr(ml, "DEALT_ROWS", 10)
    seen = []
    deal = scale.spread
    monkeypatch.setattr(ml, "spread", lambda df, *n: seen.append(deal(df, *n)) or seen[-1])
    monkeypatch.setattr(mining, "spread", ml.spread)
    if kind == "train":
        trained = ml.train(rows, "linear_regression", ["x", "c"], "y", ["id"])
        assert trained.metrics["train_size"] + trained.metrics["test_size"] == 1_000
        assert trained.metrics["r2"] == 1.0
    else:
        assert mining.clusters(rows, ["x"], 2).count() == 1_000
    assert {d.rdd.getNumPartitions() for d in seen} == {spark.sparkContext.defaultParallelism}
    assert all("unused" not in d.columns for d in seen)


def test_few_categories_are_broadcast(spark, large_plans, tmp_path):
    rows = one_split(spark, tmp_path, 1_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = ml.fit_stats(rows, ["x", "c"], "y", "regression")
        plan = ml.encode(rows, stats)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("by", [[], ["g"]])
def test_hash_ranks_agree_with_one_sort(spark, large_plans, by):
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("g")
    )
    found = scale.hash_positions(rows, ["k"], 42, "p", by)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in plan
    order = [F.xxhash64("k", F.lit(42)), F.col("k")]
    wanted = scale.row_positions(rows, order, "p", by)
    # Equal keys may trade places, which their values do not show.
    ranked = [sorted((str(r["g"]) if by else "", r["p"], str(r["k"])) for r in df.collect()) for df in (found, wanted)]
    assert ranked[0] == ranked[1]
    if not by:
        assert sorted(r["p"] for r in found.collect()) == list(range(3_000))


def test_folds_of_a_small_file_lie_on_all_cores(spark, tmp_path, monkeypatch):
    rows = one_split(spark, tmp_path, 1_000)
    monkeypatch.setattr(ml, "DEALT_ROWS", 10)
    seen = []
    deal = scale.spread
    monkeypatch.setattr(ml, "spread", lambda df, *n: seen.append(deal(df, *n)) or seen[-1])
    scores = ml.cross_validate(rows, "linear_regression", ["x", "c"], "y", ["id"]).collect()
    assert [r["score"] for r in scores] == [1.0] * 5
    assert [d.rdd.getNumPartitions() for d in seen] == [spark.sparkContext.defaultParallelism] and "fold" in seen[0].columns
