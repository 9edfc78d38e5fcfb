"""Models on targets that follow a rule exactly, so that their results have SQL.

The table's own rows carry the target: a linear sum of three columns, classes by thresholds, two far groups, and a line
over days.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.base import LINEITEM_KEY, Tables, register
from framewise.operators import mining, ml, scoring, timeseries

_LINE = "3 * l_quantity - 200 * l_discount + 50 * l_tax + 7"
_LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_KEY = ", ".join(LINEITEM_KEY)


def _lined(t: Tables):
    return t.lineitem.withColumn("amount", F.expr(_LINE).cast("double"))


def _line_model(t: Tables):
    return ml.train(_lined(t), "linear_regression", _LINE_FEATURES, "amount", LINEITEM_KEY)


def _line_metrics(t: Tables):
    runs = ml.model_runs(t.nation.sparkSession, [_line_model(t)])
    return runs.select(
        "algorithm", "status", F.round("r2", 6).alias("r2"), F.abs(F.round("mae", 4)).alias("mae"), F.abs(F.round("rmse", 4)).alias("rmse"),
        (F.col("train_size") + F.col("test_size")).alias("rows"),
    )


register(
    "train_linear_exact",
    _line_metrics,
    """SELECT 'linear_regression' AS algorithm, 'done' AS status, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse,
      count(*) AS rows FROM lineitem""",
)
register(
    "score_exact",
    lambda t: scoring.score_batch(_lined(t), _line_model(t)).select(*LINEITEM_KEY, F.round("prediction", 2).alias("prediction")),
    f"SELECT {_KEY}, round(({_LINE})::DOUBLE, 2) AS prediction FROM lineitem",
)
register(
    "what_if_exact",
    lambda t: scoring.what_if(_lined(t), {"l_discount": 0.0}, _line_model(t), LINEITEM_KEY).select(
        *LINEITEM_KEY,
        F.round("original_prediction", 2).alias("original_prediction"),
        F.round("modified_prediction", 2).alias("modified_prediction"),
        F.round("delta", 2).alias("delta"),
    ),
    f"""SELECT {_KEY}, round(({_LINE})::DOUBLE, 2) AS original_prediction,
      round((3 * l_quantity + 50 * l_tax + 7)::DOUBLE, 2) AS modified_prediction, round((200 * l_discount)::DOUBLE, 2) AS delta FROM lineitem""",
)
register(
    "scenarios_exact",
    lambda t: scoring.scenarios(
        _lined(t), _line_model(t), LINEITEM_KEY, [("untaxed", {"l_tax": 0.0}), ("large", {"l_quantity": 100.0})]
    ).select(*LINEITEM_KEY, "scenario", F.round("prediction", 2).alias("prediction"), "is_best", "is_worst"),
    f"""SELECT {_KEY}, 'untaxed' AS scenario, round((3 * l_quantity - 200 * l_discount + 7)::DOUBLE, 2) AS prediction, false AS is_best, true AS is_worst FROM lineitem
    UNION ALL SELECT {_KEY}, 'large', round((300 - 200 * l_discount + 50 * l_tax + 7)::DOUBLE, 2), true, false FROM lineitem""",
)
register(
    "cv_exact",
    lambda t: ml.cross_validate(_lined(t), "linear_regression", _LINE_FEATURES, "amount", LINEITEM_KEY),
    """SELECT fold::INT AS fold, 'r2' AS metric, 1.0::DOUBLE AS score, 1.0::DOUBLE AS mean, 0.0::DOUBLE AS std, 1.0::DOUBLE AS ci_low,
      1.0::DOUBLE AS ci_high FROM range(5) t(fold)""",
)

_STEP = "CASE WHEN c_nationkey > 12 AND c_mktsegment <> 'BUILDING' THEN 'high' WHEN c_nationkey > 6 THEN 'middle' ELSE 'low' END"
_STEP_TWO = "CASE WHEN c_nationkey > 12 AND c_mktsegment <> 'BUILDING' THEN 'yes' ELSE 'no' END"


def _stepped(t: Tables, algorithm: str, rule: str):
    rows = t.customer.withColumn("step", F.expr(rule))
    trained = ml.train(rows, algorithm, ["c_nationkey", "c_mktsegment"], "step", ["c_custkey"], "classification")
    return scoring.score_batch(rows, trained).select("c_custkey", F.col("prediction").cast("string").alias("prediction"))


for _algorithm, _rule in (("random_forest_classifier", _STEP), ("gradient_boosting_classifier", _STEP_TWO)):
    register(
        f"{_algorithm}_steps",
        lambda t, a=_algorithm, r=_rule: _stepped(t, a, r),
        f"SELECT c_custkey, {_rule} AS prediction FROM customer",
    )


def _network(t: Tables):
    wave = F.sin(F.col("c_acctbal") / 2_000) * 3 + F.col("c_nationkey") / 10
    rows = t.customer.withColumn("wave", wave)
    trained = ml.train(rows, "mlp_regressor", ["c_acctbal", "c_nationkey"], "wave", ["c_custkey"])
    runs = ml.model_runs(t.nation.sparkSession, [trained])
    return runs.select("algorithm", (F.col("r2") > 0.95).alias("fits"), (F.col("train_size") + F.col("test_size")).alias("rows"))


register(
    "train_network_regressor",
    _network,
    "SELECT 'mlp_regressor' AS algorithm, true AS fits, count(*) AS rows FROM customer",
)


def _far_groups(t: Tables):
    far = F.when(F.col("l_linenumber") >= 4, 1_000.0).otherwise(0.0)
    rows = t.lineitem.select(*LINEITEM_KEY, (far + F.col("l_tax")).alias("a"), (far * 2 + F.col("l_discount")).alias("b"))
    found = mining.clusters(rows, ["a", "b"], 2)
    return found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.col("a") >= 1_000).alias("all_far"), F.max(F.col("a") >= 1_000).alias("any_far")
    ).drop("cluster")


register(
    "kmeans_far_groups",
    _far_groups,
    "SELECT count(*) AS size, l_linenumber >= 4 AS all_far, l_linenumber >= 4 AS any_far FROM lineitem GROUP BY l_linenumber >= 4",
)


def _day_line(t: Tables):
    """200 days of orders by the key's remainder, on a line."""
    k = F.col("o_orderkey") % 200
    days = t.orders.groupBy(F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).alias("day"))
    line = days.agg((200 + 5 * F.max(k)).cast("double").alias("y"))
    return timeseries.forecast(line, "day", "y", 12).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("value", 2).alias("forecast")
    )


register(
    "forecast_line",
    _day_line,
    """WITH d AS (SELECT max(o_orderkey % 200) AS last FROM orders)
    SELECT strftime(DATE '2020-01-01' + (last + k)::INT, '%Y-%m-%d') AS date, (200 + 5 * (last + k))::DOUBLE AS forecast
    FROM d, range(1, 13) t(k)""",
)


def _split_facts(t: Tables):
    fit_rows, test_rows = ml.split(t.orders, ["o_orderkey"])
    both = fit_rows.withColumn("part", F.lit(0)).unionByName(test_rows.withColumn("part", F.lit(1)))
    share = F.sum("part") / F.count(F.lit(1))
    once = both.groupBy("o_orderkey").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))
    apart = once.agg(F.max("parts").alias("parts"), F.sum("n").alias("rows"))
    return both.agg(share.between(0.15, 0.25).alias("a_fifth")).crossJoin(apart)


register("split_facts", _split_facts, "SELECT true AS a_fifth, 1::BIGINT AS parts, count(*) AS rows FROM orders")

