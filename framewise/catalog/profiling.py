"""Column statistics, profiles, insights, readiness and roles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from framewise.catalog.base import Tables, register
from framewise.catalog.grouping import outlier_sql, rounded
from framewise.operators import profile, quality
from framewise.plans.story import data_story, next_step


def _gappy_part(t: Tables):
    """Parts with missing brands and sizes and an empty column."""
    return t.part.select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"),
        F.nullif("p_size", F.lit(7)).alias("p_size"),
        "p_retailprice",
        F.lit(None).cast("string").alias("note"),
    )


GAPPY = """(SELECT p_partkey, nullif(p_brand, 'Brand#7') AS p_brand, nullif(p_size, 7) AS p_size, p_retailprice,
  NULL::VARCHAR AS note FROM part)"""


def stat_sql(ordinal: int, column: str, dtype: str, table: str, numeric: bool) -> str:
    moments = (
        f"""round(min({column})::DOUBLE, 4) AS min, round(max({column})::DOUBLE, 4) AS max,
        round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std"""
        if numeric
        else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
    )
    return f"""SELECT {ordinal} AS ordinal, '{column}' AS "column", '{dtype}' AS dtype, count(*) AS row_count,
      count({column}) AS non_null_count, count(*) - count({column}) AS null_count,
      round((count(*) - count({column})) * 100.0 / count(*), 2) AS null_pct,
      count(DISTINCT {column}) AS unique_count, {moments} FROM {table}"""


_PART = [
    ("p_partkey", "bigint", True),
    ("p_brand", "string", False),
    ("p_size", "int", True),
    ("p_retailprice", "double", True),
    ("note", "string", False),
]

register(
    "column_stats",
    lambda t: rounded(
        profile.column_stats(_gappy_part(t), samples=False), "min", "max", "mean", "std", digits=4
    ),
    " UNION ALL ".join(stat_sql(i, c, d, GAPPY, n) for i, (c, d, n) in enumerate(_PART)),
)

_LI = [
    ("l_quantity", "double", True),
    ("l_extendedprice", "double", True),
    ("l_discount", "double", True),
    ("l_returnflag", "string", False),
]

register(
    "column_stats_lineitem",
    lambda t: rounded(
        profile.column_stats(t.lineitem.select(*[c for c, _, _ in _LI]), samples=False),
        "min",
        "max",
        "mean",
        "std",
        digits=4,
    ),
    " UNION ALL ".join(stat_sql(i, c, d, "lineitem", n) for i, (c, d, n) in enumerate(_LI)),
)

register(
    "sample_values",
    lambda t: profile.column_stats(t.part.select("p_brand", "p_type", "p_name")).select(
        "column", F.concat_ws("|", "sample_values").alias("samples")
    ),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY v) AS samples
        FROM (SELECT DISTINCT {c} AS v FROM part ORDER BY v LIMIT 5)"""
        for c in ("p_brand", "p_type", "p_name")
    ),
)


def _profile_sections(t: Tables):
    """The profile without the sections that have a query of their own."""
    rows = profile.full_profile(t.events.select("value", "event_type"))
    return rows.where(F.col("section").isin("stats", "outliers", "insight", "distribution")).select(
        "section", "column", "item", F.round("number", 4).alias("number")
    )


_EV_STATS = {
    "non_null_count": "count({c})",
    "null_count": "count(*) - count({c})",
    "null_pct": "count(*) * 0",
    "unique_count": "count(DISTINCT {c})",
}
_EV_NUMBERS = {
    "min": "min(value)",
    "max": "max(value)",
    "mean": "avg(value)",
    "std": "stddev_samp(value)",
}

register(
    "full_profile",
    _profile_sections,
    " UNION ALL ".join(
        [
            f"""SELECT 'stats' AS section, '{c}' AS "column", '{k}' AS item,
            round(({e.format(c=c)})::DOUBLE, 4) AS number FROM events"""
            for c in ("value", "event_type")
            for k, e in _EV_STATS.items()
        ]
        + [
            f"SELECT 'stats', 'value', '{k}', round(({e})::DOUBLE, 4) FROM events"
            for k, e in _EV_NUMBERS.items()
        ]
        + [
            f"SELECT 'outliers', 'value', 'count', count::DOUBLE FROM ({outlier_sql('value', 'events')})",
            f"""SELECT 'insight', 'value', 'outliers', count::DOUBLE
            FROM ({outlier_sql('value', 'events')}) WHERE pct >= 5""",
            """SELECT 'insight', '*', 'duplicates', d::DOUBLE FROM (SELECT count(*)
            - (SELECT count(*) FROM (SELECT DISTINCT value, event_type FROM events)) AS d FROM events) WHERE d > 0""",
            """SELECT 'distribution', 'event_type', row_number() OVER (ORDER BY n DESC, event_type)::VARCHAR,
            n::DOUBLE FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
            """SELECT 'distribution', 'value', g.bin::VARCHAR, coalesce(b.c, 0)::DOUBLE
            FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN (
              SELECT least(floor((value - lo) * 20 / (hi - lo)), 19)::INT AS bin, count(*) AS c
              FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1)
              b ON b.bin = g.bin""",
        ]
    ),
)

register("full_profile_whole_table", lambda t: profile.full_profile(t.events))


def _profile_sql(table: str, numeric: list[str], others: list[str]) -> str:
    """The whole profile of a table without missing values. ``numeric`` has the numeric columns."""
    columns = [*numeric, *others]
    parts = [
        f"""SELECT 'stats' AS section, '{c}' AS "column", '{k}' AS item, round(({e.format(c=c)})::DOUBLE, 4) AS number FROM {table}"""
        for c in columns
        for k, e in _EV_STATS.items()
    ]
    parts += [
        f"SELECT 'stats', '{c}', '{k}', round(({e.replace('value', c)})::DOUBLE, 4) FROM {table}"
        for c in numeric
        for k, e in _EV_NUMBERS.items()
    ]
    for c in numeric:
        parts.append(f"""SELECT 'distribution', '{c}', g.bin::VARCHAR, coalesce(b.c, 0)::DOUBLE
          FROM (SELECT unnest(range((SELECT least(count(DISTINCT {c}), 20) FROM {table}))) AS bin) g LEFT JOIN (
            SELECT least(floor(({c}::DOUBLE - lo) * n / (hi - lo)), n - 1)::INT AS bin, count(*) AS c FROM {table},
              (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, least(count(DISTINCT {c}), 20) AS n FROM {table}) GROUP BY 1) b
          ON b.bin = g.bin""")
        parts.append(f"SELECT 'outliers', '{c}', 'count', count::DOUBLE FROM ({outlier_sql(c, table)})")
        parts.append(f"SELECT 'insight', '{c}', 'outliers', count::DOUBLE FROM ({outlier_sql(c, table)}) WHERE pct >= 5")
    parts += [
        f"""SELECT 'distribution', '{c}', k::VARCHAR, n::DOUBLE FROM (SELECT n, row_number() OVER (ORDER BY n DESC, v) AS k
          FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {table} GROUP BY 1)) WHERE k <= 20"""
        for c in others
    ]
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM {table}" for a, b in combinations(numeric, 2)
    )
    parts.append(f"SELECT 'correlation', a, b, r FROM ({pairs}) WHERE r IS NOT NULL")
    parts.append(f"""SELECT 'insight', a || ',' || b, 'correlation', r
      FROM (SELECT * FROM ({pairs}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, a, b LIMIT 3) WHERE abs(r) >= 0.8""")
    parts.append(f"""SELECT 'insight', '*', 'duplicates', d::DOUBLE
      FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS d FROM {table}) WHERE d > 0""")
    return " UNION ALL ".join(parts)


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Every column, row and section, from the value counts, moments, correlations and duplicates of the table.
register(
    "full_profile_lineitem",
    lambda t: profile.full_profile(t.lineitem).select("section", "column", "item", F.round("number", 4).alias("number")),
    _profile_sql("lineitem", _LINE_NUMBERS, ["l_returnflag", "l_linestatus", "l_shipdate"]),
)

register(
    "insights",
    lambda t: profile.insights(_gappy_part(t).withColumn("day", F.lit("2024-01-05"))).withColumn(
        "number", F.round("number", 2)
    ),
    f"""WITH g AS (SELECT * FROM {GAPPY})
    SELECT 'missing_values' AS type, CASE WHEN p >= 30 THEN 'warning' ELSE 'info' END AS severity,
      c AS "column", p AS number
    FROM (SELECT 'p_brand' AS c, round((count(*) - count(p_brand)) * 100.0 / count(*), 2) AS p FROM g
      UNION ALL SELECT 'p_size', round((count(*) - count(p_size)) * 100.0 / count(*), 2) FROM g
      UNION ALL SELECT 'note', 100.0) WHERE p >= 5
    UNION ALL
    SELECT 'correlation', 'info', a || ',' || b, r FROM (
      SELECT 'p_partkey' AS a, 'p_retailprice' AS b, round(corr(p_partkey, p_retailprice), 3) AS r FROM g
      UNION ALL SELECT 'p_partkey', 'p_size', round(corr(p_partkey, p_size), 3) FROM g
      UNION ALL SELECT 'p_size', 'p_retailprice', round(corr(p_size, p_retailprice), 3) FROM g)
    WHERE abs(r) >= 0.8
    UNION ALL SELECT 'date_column', 'info', 'day', NULL""",
)

_NUMERIC_COLUMNS = ["min", "max", "mean", "median", "std", "p25", "p75", "skewness"]


def _flat_issues(df):
    return df.withColumn("issues", F.concat_ws(",", F.transform("issues", lambda i: i["type"])))


register(
    "profile_numeric",
    lambda t: _flat_issues(profile.column_profile(t.events, "value")),
    """SELECT 'value' AS "column", 'numeric' AS col_type, count(*) AS total_rows, 0 AS null_count,
      0.0::DOUBLE AS null_pct, count(DISTINCT value) AS unique_count, min(value) AS min, max(value) AS max,
      round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median,
      round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS p25,
      round(quantile_cont(value, 0.75), 4) AS p75, round(skewness(value), 3) AS skewness,
      concat_ws(',', CASE WHEN abs(skewness(value)) > 2 THEN 'skewed' END,
        CASE WHEN count(DISTINCT value) = 1 THEN 'constant_value' END,
        CASE WHEN count(DISTINCT value) >= count(*) * 0.95 AND count(*) > 10 THEN 'potential_id' END) AS issues
    FROM events""",
)

register(
    "profile_categorical",
    lambda t: _flat_issues(profile.column_profile(_gappy_part(t), "p_brand")).withColumn(
        "top_categories",
        F.concat_ws(
            ";", F.transform("top_categories", lambda c: F.concat_ws("=", c["label"], c["count"]))
        ),
    ),
    f"""WITH g AS (SELECT p_brand AS b FROM {GAPPY}),
    c AS (SELECT b, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, b) AS rn
      FROM g WHERE b IS NOT NULL GROUP BY 1)
    SELECT 'p_brand' AS "column", 'categorical' AS col_type, count(*) AS total_rows,
      count(*) - count(b) AS null_count, round((count(*) - count(b)) * 100.0 / count(*), 1) AS null_pct,
      count(DISTINCT b) AS unique_count, (SELECT b FROM c WHERE rn = 1) AS most_common,
      round((SELECT n FROM c WHERE rn = 1) * 100.0 / count(b), 1) AS most_common_pct,
      (SELECT string_agg(b || '=' || n, ';' ORDER BY rn) FROM c WHERE rn <= 10) AS top_categories, '' AS issues
    FROM g""",
)

register(
    "profile_date",
    lambda t: _flat_issues(profile.column_profile(t.orders, "o_orderdate")),
    """WITH d AS (SELECT o_orderdate AS d, lag(o_orderdate) OVER (ORDER BY o_orderdate) AS p FROM orders),
    m AS (SELECT floor(quantile_cont(date_diff('day', p, d), 0.5)) AS gap FROM d WHERE p IS NOT NULL)
    SELECT 'o_orderdate' AS "column", 'date' AS col_type, count(*) AS total_rows, 0 AS null_count,
      0.0::DOUBLE AS null_pct, count(DISTINCT o_orderdate) AS unique_count,
      strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date,
      date_diff('day', min(o_orderdate), max(o_orderdate)) AS date_range_days,
      (SELECT CASE WHEN gap <= 1 THEN 'daily' WHEN gap <= 8 THEN 'weekly' WHEN gap <= 35 THEN 'monthly'
        WHEN gap <= 100 THEN 'quarterly' ELSE 'annual' END FROM m) AS estimated_frequency, '' AS issues
    FROM orders""",
)

register(
    "profile_mostly_missing",
    lambda t: _flat_issues(
        profile.column_profile(
            t.part.select(F.when(F.col("p_size") > 40, F.col("p_type")).alias("rare")), "rare"
        )
    ).select("column", "col_type", "total_rows", "null_count", "null_pct", "issues"),
    """SELECT 'rare' AS "column", 'categorical' AS col_type, count(*) AS total_rows,
      count(*) FILTER (p_size <= 40) AS null_count,
      round(count(*) FILTER (p_size <= 40) * 100.0 / count(*), 1) AS null_pct, 'high_null_rate' AS issues
    FROM part""",
)

register(
    "column_distribution",
    lambda t: profile.column_distribution(t.customer, "c_mktsegment"),
    """SELECT (row_number() OVER (ORDER BY n DESC, label))::INT AS rank, label, n AS count
    FROM (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1)""",
)

register(
    "time_columns",
    lambda t: profile.detect_time_columns(
        t.orders.withColumn("day_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    ),
    """SELECT 'o_orderdate' AS "column", 1.0::DOUBLE AS parse_rate FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'day_text', 1.0""",
)

register(
    "pick_date_column",
    lambda t: profile.pick_date_column(
        t.orders.select(
            "o_orderpriority",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("booked"),
            F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due_date"),
        )
    ),
    """SELECT 'booked' AS "column", 1.0::DOUBLE AS parse_rate,
      date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders""",
)

# --- quality ----------------------------------------------------------------------------------

register(
    "readiness_components",
    lambda t: quality.readiness_components(_gappy_part(t).drop("note"), "p_brand"),
    f"""WITH g AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM {GAPPY}),
    m AS (SELECT greatest(count(*) - count(p_brand), count(*) - count(p_size)) * 100.0 / count(*) AS w,
      count(*) AS n FROM g),
    k AS (SELECT max(n) AS big, sum(n) AS a FROM (SELECT count(*) AS n FROM g WHERE p_brand IS NOT NULL
      GROUP BY p_brand))
    SELECT 'row_count' AS component, CASE WHEN n < 50 THEN 0 WHEN n < 200 THEN 12 WHEN n < 1000 THEN 20
        ELSE 25 END AS score, 25 AS max_score,
      CASE WHEN n < 50 THEN 'critical' WHEN n < 200 THEN 'warning' ELSE 'good' END AS status,
      n::DOUBLE AS value FROM m
    UNION ALL SELECT 'missing_values', CASE WHEN w >= 50 THEN 5 WHEN w >= 20 THEN 15 WHEN w > 0 THEN 20
        ELSE 25 END, 25, CASE WHEN w >= 50 THEN 'critical' WHEN w > 0 THEN 'warning' ELSE 'good' END,
      round(w, 2) FROM m
    UNION ALL SELECT 'duplicate_rows', 20, 20, 'good', 0.0
    UNION ALL SELECT 'feature_diversity', 15, 15, 'good', 3.0
    UNION ALL SELECT 'type_quality', 15, 15, 'good', 0.0""",
)

register(
    "readiness",
    lambda t: quality.readiness(_gappy_part(t)),
    f"""SELECT s AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C'
        WHEN s >= 45 THEN 'D' ELSE 'F' END AS grade,
      CASE WHEN s >= 75 THEN 'ready' WHEN s >= 45 THEN 'needs_attention' ELSE 'not_ready' END AS status,
      2 AS critical_count, CASE WHEN n < 200 THEN 1 ELSE 0 END AS warning_count
    FROM (SELECT CASE WHEN count(*) < 50 THEN 0 WHEN count(*) < 200 THEN 12 WHEN count(*) < 1000 THEN 20
      ELSE 25 END + 5 + 20 + 15 + 5 AS s, count(*) AS n FROM {GAPPY})""",
)

register(
    "readiness_duplicates",
    lambda t: quality.duplicate_score(t.lineitem.select("l_returnflag", "l_quantity", "l_discount")),
    """SELECT 'duplicate_rows' AS component, CASE WHEN p >= 20 THEN 5 WHEN p >= 5 THEN 12 WHEN p > 0 THEN 17
        ELSE 20 END AS score, 20 AS max_score,
      CASE WHEN p >= 20 THEN 'critical' WHEN p > 0 THEN 'warning' ELSE 'good' END AS status, round(p, 2) AS value
    FROM (SELECT (count(*) - (SELECT count(*) FROM
      (SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM lineitem))) / count(*) * 100 AS p FROM lineitem)""",
)

register(
    "readiness_duplicates_whole_rows",
    lambda t: quality.duplicate_score(t.lineitem.unionByName(t.lineitem.where(F.col("l_linenumber") == 1))),
    """WITH b AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
    SELECT 'duplicate_rows' AS component, CASE WHEN p >= 20 THEN 5 WHEN p >= 5 THEN 12 WHEN p > 0 THEN 17
        ELSE 20 END AS score, 20 AS max_score,
      CASE WHEN p >= 20 THEN 'critical' WHEN p > 0 THEN 'warning' ELSE 'good' END AS status, round(p, 2) AS value
    FROM (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b))) / count(*) * 100 AS p FROM b)""",
)

register(
    "class_balance",
    lambda t: quality.class_balance(
        t.events.withColumn("bought", F.when(F.col("value") < 1, "yes").otherwise("no")), "bought"
    ),
    """SELECT 'bought' AS target, 2 AS classes, round(greatest(a, b) * 100.0 / (a + b), 1) AS majority_pct,
      round(least(a, b) * 100.0 / (a + b), 1) AS minority_pct,
      CASE WHEN greatest(a, b) * 100.0 / (a + b) >= 95 THEN 'critical'
        WHEN greatest(a, b) * 100.0 / (a + b) >= 80 THEN 'warning' ELSE 'good' END AS status
    FROM (SELECT count(*) FILTER (value < 1) AS a, count(*) FILTER (value >= 1) AS b FROM events)""",
)

register(
    "column_roles",
    lambda t: quality.classify_columns(t.customer.withColumn("is_debtor", F.col("c_acctbal") < 0)).select(
        "column", "dtype", "unique_count", "col_type"
    ),
    """SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(DISTINCT c_custkey) AS unique_count,
      'id' AS col_type FROM customer
    UNION ALL SELECT 'c_name', 'string', count(DISTINCT c_name), 'id' FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', count(DISTINCT c_nationkey),
      CASE WHEN count(DISTINCT c_nationkey) / count(*) > 0.1 THEN 'metric' ELSE 'dimension' END FROM customer
    UNION ALL SELECT 'c_acctbal', 'double', count(DISTINCT c_acctbal), 'id' FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', count(DISTINCT c_mktsegment), 'dimension' FROM customer
    UNION ALL SELECT 'is_debtor', 'boolean', count(DISTINCT c_acctbal < 0), 'flag' FROM customer""",
)

register(
    "data_dictionary",
    lambda t: quality.data_dictionary(t.part.select("p_brand", "p_size")).select(
        "column", "col_type", "null_pct", "description"
    ),
    """SELECT 'p_brand' AS "column", 'dimension' AS col_type, 0.0::DOUBLE AS null_pct,
      'Puts rows into groups; models need it encoded. '
      || count(DISTINCT p_brand) || ' distinct values.' AS description FROM part
    UNION ALL SELECT 'p_size', 'metric', 0.0,
      'Holds measured numbers, fit to predict or to be predicted. Range: '
      || printf('%.2f', min(p_size)::DOUBLE) || ' – ' || printf('%.2f', max(p_size)::DOUBLE)
      || ' (avg ' || printf('%.2f', avg(p_size)) || ').' FROM part""",
)

register(
    "model_readiness",
    lambda t: quality.model_readiness(
        t.supplier.select(
            F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("id"),
            F.lit("linear_regression").alias("algorithm"),
            F.when(F.col("s_nationkey") % 2 == 0, "regression").otherwise("classification").alias("problem_type"),
            F.when(F.col("s_nationkey") == 5, "failed").otherwise("done").alias("status"),
            (F.col("s_nationkey") > 12).alias("is_selected"),
            F.round(F.col("s_acctbal") / 10000, 3).alias("r2"),
            F.round(F.col("s_acctbal") / 10000, 3).alias("accuracy"),
        ),
        _gappy_part(t),
        feature_count=3,
    ),
    f"""WITH m AS (SELECT count(*) AS n, ((count(*) - count(p_brand)) + (count(*) - count(p_size)) + count(*))
        * 100.0 / (count(*) * 5) AS gap FROM {GAPPY}),
    r AS (SELECT 'run' || s_suppkey AS id, s_nationkey % 2 = 0 AS reg, s_nationkey > 12 AS sel,
        round(s_acctbal / 10000, 3) AS v FROM supplier WHERE s_nationkey <> 5),
    p AS (SELECT id, 'linear_regression' AS algorithm, 10 AS training_points,
      CASE WHEN n >= 100 THEN 20 WHEN n >= 50 THEN 10 ELSE 0 END AS data_points,
      CASE WHEN v >= CASE WHEN reg THEN 0.7 ELSE 0.8 END THEN 30
        WHEN v >= CASE WHEN reg THEN 0.5 ELSE 0.65 END THEN 15 ELSE 0 END AS accuracy_points,
      15 AS feature_points, CASE WHEN gap < 10 THEN 15 WHEN gap < 30 THEN 8 ELSE 0 END AS quality_points,
      CASE WHEN sel THEN 10 ELSE 0 END AS selected_points FROM r, m),
    s AS (SELECT *, training_points + data_points + accuracy_points + feature_points + quality_points
      + selected_points AS score FROM p)
    SELECT *, CASE WHEN score >= 85 THEN 'ready' WHEN score >= 60 THEN 'needs_attention' ELSE 'not_ready' END
      AS verdict FROM s""",
)

register(
    "data_story",
    lambda t: data_story(
        t.customer, ["c_custkey"], target="c_acctbal", with_anomalies=False
    ),
    """WITH s AS (SELECT CASE WHEN count(*) < 50 THEN 0 WHEN count(*) < 200 THEN 12 WHEN count(*) < 1000 THEN 20
        ELSE 25 END AS r, CASE WHEN count(*) < 50 THEN 'critical' WHEN count(*) < 200 THEN 'warning'
        ELSE 'good' END AS st FROM customer),
    k AS (SELECT round(corr(c_acctbal, c_custkey), 4) AS a, round(corr(c_acctbal, c_nationkey), 4) AS b
      FROM customer)
    SELECT 'readiness' AS section, 'total' AS item, (r + 25 + 20 + 15 + 11)::DOUBLE AS number,
      CASE WHEN r + 71 >= 90 THEN 'A' ELSE 'B' END AS text FROM s
    UNION ALL SELECT 'readiness', 'row_count', r::DOUBLE, st FROM s
    UNION ALL SELECT 'readiness', 'missing_values', 25.0, 'good'
    UNION ALL SELECT 'readiness', 'duplicate_rows', 20.0, 'good'
    UNION ALL SELECT 'readiness', 'feature_diversity', 15.0, 'good'
    UNION ALL SELECT 'readiness', 'type_quality', 11.0, 'warning'
    UNION ALL SELECT 'breakdown', c_mktsegment, sum(c_custkey)::DOUBLE, 'c_mktsegment' FROM customer
      GROUP BY c_mktsegment
    UNION ALL SELECT 'drivers', 'c_custkey', a, 'negligible' FROM k
    UNION ALL SELECT 'drivers', 'c_nationkey', b, 'negligible' FROM k""",
)

register("data_story_anomalies", lambda t: data_story(t.customer, ["c_custkey"]))
register("data_story_whole", lambda t: data_story(t.customer, ["c_custkey"], target="c_acctbal"))

register(
    "next_step",
    lambda t: next_step(t.orders, "o_totalprice"),
    """SELECT 'train_model' AS next_step, CASE WHEN count(*) < 1000 THEN 20 ELSE 25 END + 75 AS score,
      'A' AS grade FROM orders""",
)
