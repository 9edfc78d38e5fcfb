"""Clusters, anomalies, training, tuning, validation, explanation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.base import LINEITEM_KEY, Tables, register
from framewise.operators import mining, ml, scoring

_SHAPE = ["l_quantity", "l_extendedprice", "l_discount"]


def _priced(t: Tables):
    """Line items with the amount paid: a target that depends on the other columns."""
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t.lineitem.withColumn("paid", F.round(paid, 2))


def _customers(t: Tables):
    """Customers with a class that depends on balance and nation."""
    rank = F.col("c_acctbal") / 1000 + F.col("c_nationkey") / 5
    return t.customer.withColumn(
        "tier", F.when(rank > 9, "gold").when(rank > 5, "silver").otherwise("basic")
    ).withColumn("active", F.when(rank > 6, "yes").otherwise("no"))


_PRICE_FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag"]
_TIER_FEATURES = ["c_acctbal", "c_nationkey", "c_mktsegment"]


def _clusters(t: Tables):
    return mining.clusters(t.lineitem.select(*LINEITEM_KEY, *_SHAPE), _SHAPE, 3)


register("kmeans", lambda t: _clusters(t).groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
register(
    "kmeans_auto",
    lambda t: mining.clusters(t.supplier),
)
register("cluster_profiles", lambda t: mining.cluster_profiles(_clusters(t), _SHAPE))

# The assignment comes from a rule here, so the profile has an exact answer.
register(
    "cluster_profiles_rule",
    lambda t: mining.cluster_profiles(
        t.lineitem.withColumn("cluster", F.when(F.col("l_quantity") > 30, 1).otherwise(0)), ["l_quantity", "l_tax"]
    ),
    """WITH a AS (SELECT CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS cluster, l_quantity, l_tax FROM lineitem),
    g AS (SELECT count(*) AS n, avg(l_quantity) AS gq, avg(l_tax) AS gt, stddev_samp(l_quantity) AS sq,
      stddev_samp(l_tax) AS st FROM a),
    c AS (SELECT cluster, count(*) AS size, avg(l_quantity) AS mq, avg(l_tax) AS mt FROM a GROUP BY 1),
    l AS (SELECT cluster, size, round(size / n * 100, 1) AS size_pct, 'l_quantity' AS feature,
        round(mq, 4) AS cluster_mean, round(gq, 4) AS global_mean, (round(mq, 4) - gq) / sq AS d FROM c, g
      UNION ALL SELECT cluster, size, round(size / n * 100, 1), 'l_tax', round(mt, 4), round(gt, 4),
        (round(mt, 4) - gt) / st FROM c, g)
    SELECT cluster, size, size_pct, feature, cluster_mean, global_mean,
      CASE WHEN abs(d) >= 0.5 THEN CASE WHEN d > 0 THEN 'above' ELSE 'below' END END AS direction,
      CASE WHEN abs(d) >= 0.5 THEN round(abs(d), 2) END AS magnitude, abs(d) >= 0.5 AS distinguishing FROM l""",
)

register(
    "anomalies",
    lambda t: mining.anomalies(
        t.lineitem.select(*LINEITEM_KEY, *_SHAPE, "l_tax"), [*_SHAPE, "l_tax"], LINEITEM_KEY
    ),
)
register(
    "anomaly_counts",
    lambda t: mining.anomaly_scores(t.events.select("event_id", "value", "user_id"), ["value", "user_id"], ["event_id"])
    .groupBy("is_anomaly")
    .agg(F.count(F.lit(1)).alias("n")),
)

# --- training ---------------------------------------------------------------------------------


def _linear(t: Tables):
    return ml.train(_priced(t), "linear_regression", _PRICE_FEATURES, "paid", LINEITEM_KEY)


def _tiers(t: Tables, algorithm: str = "random_forest_classifier", target: str = "tier"):
    return ml.train(_customers(t), algorithm, _TIER_FEATURES, target, ["c_custkey"], "classification")


def _metrics(t: Tables, trained):
    return ml.model_runs(t.nation.sparkSession, [trained]).drop("training_duration_ms")


register("train_linear", lambda t: _metrics(t, _linear(t)))
register("train_logistic", lambda t: _metrics(t, _tiers(t, "logistic_regression", "active")))
register("train_forest_classifier", lambda t: _metrics(t, _tiers(t)))
register("train_boosting_classifier", lambda t: _metrics(t, _tiers(t, "gradient_boosting_classifier", "active")))
register("train_boosting_multiclass", lambda t: _metrics(t, _tiers(t, "xgboost_classifier")))
register("train_neural_network", lambda t: _metrics(t, _tiers(t, "neural_network_classifier")))


def _several(t: Tables):
    return ml.train_many(
        t.orders.withColumn("year", F.year("o_orderdate")).withColumn(
            "score", F.col("o_totalprice") / 1000 + F.col("year") % 7 * 10
        ),
        ["linear_regression", "random_forest_regressor", "gradient_boosting_regressor"],
        ["o_totalprice", "year", "o_orderpriority"],
        "score",
        ["o_orderkey"],
        "regression",
    )


register(
    "train_many",
    lambda t: ml.compare_models(ml.model_runs(t.orders.sparkSession, _several(t))).drop("training_duration_ms"),
)


def _retrain(t: Tables):
    runs = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.lit("linear_regression").alias("algorithm"),
        F.lit("done").alias("status"),
        (F.col("s_suppkey") == 3).alias("is_selected"),
        F.col("s_suppkey").alias("created_at"),
    )
    trained = ml.retrain(_priced(t), runs, _PRICE_FEATURES, "paid", LINEITEM_KEY)
    return _metrics(t, trained)


register("retrain", _retrain)

register(
    "prepare_features",
    lambda t: ml.prepare_features(_customers(t), _TIER_FEATURES, "tier", "classification").select(
        "c_custkey",
        F.round("_e_c_acctbal", 2).alias("balance"),
        F.col("_e_c_mktsegment").cast("int").alias("segment"),
        F.col("label").cast("int").alias("label"),
    ),
    """SELECT c_custkey, round(c_acctbal, 2) AS balance,
      (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS segment,
      CASE WHEN c_acctbal / 1000 + c_nationkey / 5 > 9 THEN 1 WHEN c_acctbal / 1000 + c_nationkey / 5 > 5 THEN 2
        ELSE 0 END AS label FROM customer""",
)


def _split_counts(t: Tables):
    fit_rows, test_rows = ml.split(t.orders, ["o_orderkey"])
    tagged = fit_rows.withColumn("part", F.lit("train")).unionByName(test_rows.withColumn("part", F.lit("test")))
    return tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))


register("split", _split_counts)

register(
    "tune",
    lambda t: ml.tune(
        _customers(t),
        "logistic_regression",
        ["c_acctbal", "c_nationkey"],
        "active",
        ["c_custkey"],
        "classification",
    )[1],
)
register(
    "cv",
    lambda t: ml.cross_validate(_priced(t), "linear_regression", _PRICE_FEATURES, "paid", LINEITEM_KEY),
)
register(
    "cv_stratified",
    lambda t: ml.cross_validate(
        _customers(t), "logistic_regression", ["c_acctbal", "c_nationkey"], "tier", ["c_custkey"],
        "classification",
    ),
)

# --- explanation and scoring ------------------------------------------------------------------

register("importance", lambda t: ml.model_importance(t.nation.sparkSession, _tiers(t)))


def _card(t: Tables):
    trained = _tiers(t)
    spark = t.nation.sparkSession
    runs = ml.model_runs(spark, [trained]).withColumn("is_selected", F.lit(True))
    card = ml.model_card(runs, ml.model_importance(spark, trained), t.customer.count(), len(_TIER_FEATURES))
    return card.withColumns(
        {n: F.concat_ws(",", n) for n in ("top_features", "limitations")}
    )


register("model_card", _card)
register("feature_schema", lambda t: ml.feature_schema(t.nation.sparkSession, _tiers(t).stats))


def _scored(t: Tables):
    return scoring.score_batch(_priced(t).drop("l_shipdate"), _linear(t))


register("score", _scored)


def _score_gaps(t: Tables):
    """Classes of rows with missing numbers and a segment the model never saw."""
    rows = t.customer.withColumns(
        {
            "c_acctbal": F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")),
            "c_mktsegment": F.when(F.col("c_custkey") % 2 == 0, F.lit("SPACE")).otherwise(F.col("c_mktsegment")),
        }
    )
    return scoring.score_batch(rows, _tiers(t))


register("score_missing_and_unseen", _score_gaps)
register(
    "class_probabilities", lambda t: scoring.class_probabilities(_customers(t), _tiers(t), ["c_custkey"])
)
register("explain_scores", lambda t: scoring.explain_batch(_customers(t), _tiers(t), ["c_custkey"]))
register("what_if", lambda t: scoring.what_if(_priced(t), {"l_discount": 0.0}, _linear(t), LINEITEM_KEY))
register(
    "scenarios",
    lambda t: scoring.scenarios(
        _priced(t),
        _linear(t),
        LINEITEM_KEY,
        [("no discount", {"l_discount": 0.0}), ("returned", {"l_returnflag": "R"})],
    ),
)
register(
    "compare_deployments",
    lambda t: scoring.compare_deployments(
        _customers(t),
        {"forest": _tiers(t), "logistic": _tiers(t, "logistic_regression")},
        ["c_custkey"],
    ),
)
