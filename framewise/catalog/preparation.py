"""Cleaning and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.base import LINEITEM_KEY, Tables, register
from framewise.catalog.grouping import rounded
from framewise.operators import cleaning, features
from framewise.plans.cleaning import clean
from framewise.plans.features import apply_transforms


def _gaps(t: Tables):
    """Parts with missing sizes, prices and types."""
    return t.part.select(
        "p_partkey",
        F.nullif("p_size", F.lit(7)).alias("size"),
        F.when(F.col("p_size") != 9, F.col("p_retailprice")).alias("price"),
        F.nullif("p_type", F.lit("SMALL")).alias("kind"),
    )


GAPS = """(SELECT p_partkey, nullif(p_size, 7) AS size, CASE WHEN p_size <> 9 THEN p_retailprice END AS price,
  nullif(p_type, 'SMALL') AS kind FROM part)"""

_FILLS = {
    "mean": ("price", None, f"(SELECT avg(price) FROM {GAPS})"),
    "median": ("price", None, f"(SELECT quantile_cont(price, 0.5) FROM {GAPS})"),
    "zero": ("price", None, "0.0"),
    "value": ("price", 12.5, "12.5"),
}
for _strategy, (_column, _value, _sql) in _FILLS.items():
    register(
        f"fill_{_strategy}",
        lambda t, c=_column, s=_strategy, v=_value: rounded(
            cleaning.fill_missing(_gaps(t), c, s, v), c, digits=4
        ),
        f"SELECT p_partkey, size, round(coalesce(price, {_sql}), 4) AS price, kind FROM {GAPS}",
    )

register(
    "fill_mode",
    lambda t: cleaning.fill_missing(_gaps(t), "kind", "mode"),
    f"""SELECT p_partkey, size, price, coalesce(kind, (SELECT kind FROM {GAPS} WHERE kind IS NOT NULL
      GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {GAPS}""",
)

register(
    "fill_report",
    lambda t: cleaning.fill_report(_gaps(t), "size", "median"),
    f"""SELECT 'size' AS "column", 'median' AS strategy, count(*) AS row_count,
      count(*) - count(size) AS modified_count FROM {GAPS}""",
)

register(
    "cap_outliers",
    lambda t: rounded(
        clean(
            t.lineitem.select(*LINEITEM_KEY, "l_extendedprice"),
            {"operation": "cap_outliers", "column": "l_extendedprice", "percentile": 95},
        ),
        "l_extendedprice",
        digits=4,
    ),
    """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi
      FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice FROM lineitem, b""",
)

register(
    "cap_outliers_missing",
    lambda t: rounded(cleaning.cap_outliers(_gaps(t), "price", 99.99), "price", digits=4).select(
        "p_partkey", "price"
    ),
    f"""WITH b AS (SELECT quantile_cont(price, 0.001) AS lo, quantile_cont(price, 0.999) AS hi FROM {GAPS})
    SELECT p_partkey, CASE WHEN price IS NOT NULL THEN round(least(greatest(price, lo), hi), 4) END AS price
    FROM {GAPS}, b""",
)

register(
    "cap_report",
    lambda t: cleaning.cap_report(t.events, "value", 90),
    """WITH b AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events)
    SELECT round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
      count(*) AS row_count, count(*) FILTER (value < lo OR value > hi) AS modified_count FROM events, b""",
)


def _dedupe_report(t: Tables):
    before = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity")
    return cleaning.cleaning_report(before, clean(before, {"operation": "remove_duplicates"}), "remove_duplicates")


register(
    "cleaning_report",
    _dedupe_report,
    """SELECT 'remove_duplicates' AS operation, count(*) AS before_rows,
      count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS after_rows,
      count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS modified_count,
      3 AS before_columns, 3 AS after_columns FROM lineitem""",
)


def _dedupe_report_whole_rows(t: Tables):
    before = t.lineitem.unionByName(t.lineitem.where(F.col("l_linenumber") == 1))
    return cleaning.cleaning_report(before, clean(before, {"operation": "remove_duplicates"}), "remove_duplicates")


register(
    "cleaning_report_whole_rows",
    _dedupe_report_whole_rows,
    """WITH b AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1),
    a AS (SELECT DISTINCT * FROM b)
    SELECT 'remove_duplicates' AS operation, (SELECT count(*) FROM b) AS before_rows,
      (SELECT count(*) FROM a) AS after_rows,
      (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS modified_count,
      11 AS before_columns, 11 AS after_columns""",
)

register(
    "clean_filter_rows",
    lambda t: clean(
        t.customer,
        {"operation": "filter_rows", "column": "c_acctbal", "operator": "lt", "value": 0},
    ),
    "SELECT * FROM customer WHERE NOT (c_acctbal < 0)",
)

# --- features ---------------------------------------------------------------------------------

register(
    "date_parts",
    lambda t: features.date_decompose(
        t.orders.select(
            "o_orderkey",
            F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise("unknown")
            .alias("day"),
        ),
        "day",
    ),
    """WITH d AS (SELECT o_orderkey, o_orderdate AS t, o_orderstatus <> 'P' AS ok FROM orders)
    SELECT o_orderkey, CASE WHEN ok THEN strftime(t, '%Y-%m-%d') ELSE 'unknown' END AS day,
      CASE WHEN ok THEN year(t) END AS day_year, CASE WHEN ok THEN month(t) END AS day_month,
      CASE WHEN ok THEN isodow(t) - 1 END AS day_dayofweek,
      CASE WHEN ok AND isodow(t) >= 6 THEN 1 ELSE 0 END AS day_is_weekend FROM d""",
)

register(
    "log1p",
    lambda t: rounded(
        features.log_transform(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal"),
        "c_acctbal_log",
        digits=4,
    ),
    """SELECT c_custkey, c_acctbal, round(ln(1 + greatest(c_acctbal, 0)), 4) AS c_acctbal_log FROM customer""",
)

register(
    "quartile",
    lambda t: features.bin_quartile(_gaps(t).select("p_partkey", "price"), "price"),
    f"""WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b,
      quantile_cont(price, 0.75) AS c FROM {GAPS})
    SELECT p_partkey, price, CASE WHEN price IS NULL THEN 'nan' WHEN price <= a THEN 'Q1' WHEN price <= b THEN 'Q2'
      WHEN price <= c THEN 'Q3' ELSE 'Q4' END AS price_quartile FROM {GAPS}, q""",
)

_KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"]

register(
    "one_hot",
    lambda t: features.one_hot(_gaps(t).select("p_partkey", "kind"), "kind"),
    "SELECT p_partkey, kind, "
    + ", ".join(f"coalesce((kind = '{k}')::INT, 0) AS \"kind_{k}\"" for k in _KINDS)
    + f', (kind IS NULL)::INT AS "kind_MISSING" FROM {GAPS}',
)

register(
    "label_encode",
    lambda t: features.label_encode(
        t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#3")).alias("brand")), "brand"
    ),
    """WITH b AS (SELECT p_partkey, nullif(p_brand, 'Brand#3') AS brand FROM part),
    l AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS i FROM
      (SELECT DISTINCT brand FROM b WHERE brand IS NOT NULL))
    SELECT p_partkey, b.brand, coalesce(i, -1)::INT AS brand_encoded FROM b LEFT JOIN l ON b.brand = l.brand""",
)

register(
    "label_encode_many",
    lambda t: features.label_encode(t.customer.select("c_custkey", "c_name"), "c_name"),
    """SELECT c_custkey, c_name, (dense_rank() OVER (ORDER BY c_name) - 1)::INT AS c_name_encoded
    FROM customer""",
)

register(
    "interaction",
    lambda t: rounded(
        features.interaction(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice"),
        "p_size_x_p_retailprice",
        digits=4,
    ),
    """SELECT p_partkey, p_size, p_retailprice, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice
    FROM part""",
)


def _steps(t: Tables):
    steps = [
        {"column": "p_type", "transform_type": "label_encode"},
        {"column": "p_retailprice", "transform_type": "bin_quartile"},
        {"column": "no_such_column", "transform_type": "log_transform"},
        {"column": "p_type_encoded__p_size", "transform_type": "interaction"},
    ]
    table, _ = apply_transforms(t.part.select("p_partkey", "p_type", "p_size", "p_retailprice"), steps)
    return table


register(
    "apply_transforms",
    _steps,
    """WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b,
      quantile_cont(p_retailprice, 0.75) AS c FROM part),
    e AS (SELECT *, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS p_type_encoded FROM part)
    SELECT p_partkey, p_type, p_size, p_retailprice, p_type_encoded,
      CASE WHEN p_retailprice <= a THEN 'Q1' WHEN p_retailprice <= b THEN 'Q2' WHEN p_retailprice <= c THEN 'Q3'
        ELSE 'Q4' END AS p_retailprice_quartile, p_type_encoded * p_size AS p_type_encoded_x_p_size FROM e, q""",
)

register(
    "suggest_features",
    lambda t: features.suggest_features(
        t.part.withColumn("launch", F.lit("2024-03-01")).withColumn(
            "weight", F.exp(F.col("p_size") / F.lit(5.0))
        )
    ),
    """WITH s AS (SELECT skewness(exp(p_size / 5.0)) AS sk, count(DISTINCT p_retailprice) AS np,
        count(DISTINCT p_size) AS nw, count(DISTINCT p_brand) AS nb, count(DISTINCT p_name) AS nn,
        count(DISTINCT p_type) AS nt, abs(corr(p_partkey, p_size)) AS c1, abs(corr(p_partkey, p_retailprice)) AS c2,
        abs(corr(p_partkey, exp(p_size / 5.0))) AS c3, abs(corr(p_size, p_retailprice)) AS c4,
        abs(corr(p_size, exp(p_size / 5.0))) AS c5, abs(corr(p_retailprice, exp(p_size / 5.0))) AS c6 FROM part),
    u AS (
      SELECT 1 AS o, 'p_retailprice' AS "column", 'bin_quartile' AS transform_type FROM s WHERE np > 20
      UNION ALL SELECT 2, 'launch', 'date_decompose'
      UNION ALL SELECT 3, 'weight', 'log_transform' FROM s WHERE sk > 1.5
      UNION ALL SELECT 4, 'weight', 'bin_quartile' FROM s WHERE nw > 20
      UNION ALL SELECT 5, 'p_name', CASE WHEN nn <= 15 THEN 'one_hot' ELSE 'label_encode' END FROM s WHERE nn <= 50
      UNION ALL SELECT 6, 'p_brand', CASE WHEN nb <= 15 THEN 'one_hot' ELSE 'label_encode' END FROM s WHERE nb <= 50
      UNION ALL SELECT 7, 'p_type', CASE WHEN nt <= 15 THEN 'one_hot' ELSE 'label_encode' END FROM s WHERE nt <= 50
      UNION ALL SELECT 8, 'p_partkey__p_size', 'interaction' FROM s WHERE c1 >= 0.5
      UNION ALL SELECT 9, 'p_partkey__p_retailprice', 'interaction' FROM s WHERE c2 >= 0.5
      UNION ALL SELECT 10, 'p_partkey__weight', 'interaction' FROM s WHERE c3 >= 0.5
      UNION ALL SELECT 11, 'p_size__p_retailprice', 'interaction' FROM s WHERE c4 >= 0.5
      UNION ALL SELECT 12, 'p_size__weight', 'interaction' FROM s WHERE c5 >= 0.5
      UNION ALL SELECT 13, 'p_retailprice__weight', 'interaction' FROM s WHERE c6 >= 0.5)
    SELECT (row_number() OVER (ORDER BY o))::INT AS rank, "column", transform_type FROM u""",
)

register(
    "problem_type",
    lambda t: features.detect_problem_type(t.part, "p_size")
    .unionByName(features.detect_problem_type(t.part, "p_retailprice"))
    .unionByName(features.detect_problem_type(t.part, "p_brand")),
    """SELECT 'p_size' AS target, CASE WHEN count(DISTINCT p_size) <= greatest(10, floor(count(*) * 0.05))
        THEN 'classification' ELSE 'regression' END AS problem_type, count(*) AS non_null,
      count(DISTINCT p_size) AS classes FROM part
    UNION ALL SELECT 'p_retailprice', 'regression', count(*), count(DISTINCT p_retailprice) FROM part
    UNION ALL SELECT 'p_brand', 'classification', count(*), count(DISTINCT p_brand) FROM part""",
)

register(
    "target_classes",
    lambda t: features.target_classes(t.part, "p_brand"),
    """SELECT p_brand AS class, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, class LIMIT 20""",
)


def mi_sql() -> str:
    """Binned mutual information of three columns with p_type."""
    edges = ", ".join(f"quantile_cont({{c}}, {i / 10}) AS e{i}" for i in range(1, 10))
    code = "CASE " + " ".join(f"WHEN {{c}} <= e{i} THEN {i}" for i in range(1, 10)) + " ELSE 10 END"
    parts = []
    for c in ("p_size", "p_retailprice"):
        parts.append(
            f"""SELECT '{c}' AS f, ({code.format(c=c)})::VARCHAR AS x, p_type AS y
            FROM part, (SELECT {edges.format(c=c)} FROM part)"""
        )
    parts.append("SELECT 'p_brand' AS f, p_brand AS x, p_type AS y FROM part")
    return f"""WITH d AS ({' UNION ALL '.join(parts)}),
    j AS (SELECT f, x, y, count(*) AS n FROM d GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY f, x) AS nx, sum(n) OVER (PARTITION BY f, y) AS ny,
      sum(n) OVER (PARTITION BY f) AS t FROM j),
    s AS (SELECT f, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi FROM m GROUP BY f),
    p AS (SELECT f AS "column", round(mi, 4) AS importance, round(mi / sum(mi) OVER () * 100, 1)
      AS importance_pct FROM s)
    SELECT *, (row_number() OVER (ORDER BY importance DESC, "column"))::INT AS rank,
      CASE WHEN importance_pct >= 20 THEN 'very strong' WHEN importance_pct >= 10 THEN 'strong'
        WHEN importance_pct >= 5 THEN 'moderate' WHEN importance_pct >= 1 THEN 'weak' ELSE 'very low' END AS strength
    FROM p"""


register(
    "mi_importance",
    lambda t: features.feature_importance_mi(t.part, "p_type", ["p_size", "p_retailprice", "p_brand"]),
    mi_sql(),
)
