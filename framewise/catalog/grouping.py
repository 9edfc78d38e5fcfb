"""Grouped statistics, pivots, distributions, correlations and segment or period comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.base import Tables, register
from framewise.operators import aggregates, compare, relational
from framewise.plans.query_spec import run_query_spec


def rounded(df, *names: str, digits: int = 2):
    """Floating sums differ in the last bits between engines and plans: compare rounded."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _flagged(t: Tables):
    """Line items whose return flag is missing for N."""
    return t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N")))


_AGG_SQL = {
    "sum": "sum({0})",
    "mean": "avg({0})",
    "min": "min({0})",
    "max": "max({0})",
    "median": "quantile_cont({0}, 0.5)",
}
for _agg, _f in _AGG_SQL.items():
    register(
        f"group_stats_{_agg}",
        lambda t, agg=_agg: rounded(
            aggregates.group_stats(_flagged(t), "flag", ["l_quantity", "l_extendedprice"], agg),
            "l_quantity",
            "l_extendedprice",
            digits=3,
        ),
        f"""SELECT nullif(l_returnflag, 'N') AS flag, round({_f.format('l_quantity')}, 3) AS l_quantity,
          round({_f.format('l_extendedprice')}, 3) AS l_extendedprice FROM lineitem GROUP BY 1""",
    )

register(
    "group_stats_count",
    lambda t: aggregates.group_stats(t.orders, "o_custkey", ["o_totalprice"], "count"),
    """SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1
    ORDER BY count DESC, o_custkey LIMIT 30""",
)

register(
    "group_stats_all_columns",
    lambda t: rounded(aggregates.group_stats(t.supplier, "s_nationkey"), "s_acctbal"),
    """SELECT s_nationkey, sum(s_suppkey)::BIGINT AS s_suppkey, round(sum(s_acctbal), 2) AS s_acctbal
    FROM supplier GROUP BY 1 ORDER BY sum(s_suppkey) DESC, s_nationkey LIMIT 30""",
)

register(
    "group_share",
    lambda t: rounded(
        aggregates.group_total(t.lineitem, "l_returnflag", "l_extendedprice"), "l_extendedprice", "total"
    ),
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice,
      round((SELECT sum(l_extendedprice) FROM lineitem), 2) AS total,
      round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem) * 100, 1) AS share_pct
    FROM lineitem GROUP BY 1""",
)

register(
    "crosstab_sum",
    lambda t: rounded(
        aggregates.crosstab_cells(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice"), "value"
    ),
    """SELECT l_returnflag AS row_label, l_linestatus AS col_label, round(sum(l_extendedprice), 2) AS value
    FROM lineitem GROUP BY 1, 2""",
)

_CAPPED = """WITH c AS (SELECT p_brand AS r, p_size AS c, {f} AS v FROM part GROUP BY 1, 2),
  rs AS (SELECT DISTINCT r FROM c ORDER BY r LIMIT 15), cs AS (SELECT DISTINCT c FROM c ORDER BY c LIMIT 10),
  g AS (SELECT rs.r, cs.c, coalesce(c.v, 0) AS v FROM rs CROSS JOIN cs
    LEFT JOIN c ON c.r = rs.r AND c.c = cs.c) """

register(
    "crosstab_capped_count",
    lambda t: aggregates.crosstab_cells(t.part, "p_brand", "p_size", agg="count"),
    _CAPPED.format(f="count(*)") + "SELECT r AS row_label, c AS col_label, v AS value FROM g",
)

register(
    "crosstab_capped_mean_totals",
    lambda t: rounded(
        aggregates.crosstab_totals(t.part, "p_brand", "p_size", "p_retailprice", "mean"), "total"
    ),
    _CAPPED.format(f="avg(p_retailprice)")
    + """SELECT 'row' AS kind, r AS label, round(sum(v), 2) AS total FROM g GROUP BY r
    UNION ALL SELECT 'column', c::VARCHAR, round(sum(v), 2) FROM g GROUP BY c
    UNION ALL SELECT 'grand', 'all', round(sum(v), 2) FROM g""",
)

register(
    "crosstab_overall",
    lambda t: rounded(
        aggregates.crosstab_overall(t.part, "p_brand", "p_size", "p_retailprice", "mean"), "overall", digits=4
    ),
    """SELECT round(avg(p_retailprice), 4) AS overall FROM part
    WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 15)
      AND p_size IN (SELECT DISTINCT p_size FROM part ORDER BY 1 LIMIT 10)""",
)

register(
    "crosstab_wide",
    lambda t: aggregates.crosstab(t.lineitem, "l_returnflag", "l_linestatus", agg="count"),
    """SELECT l_returnflag AS row_label, count(*) FILTER (l_linestatus = 'F') AS "F",
      count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""",
)

register(
    "bar_mean",
    lambda t: rounded(aggregates.bar_data(t.part, "p_brand", "p_retailprice", "mean"), "value", digits=4),
    """SELECT p_brand AS label, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1
    ORDER BY avg(p_retailprice) DESC, label LIMIT 20""",
)

register(
    "bar_first_rows",
    lambda t: aggregates.bar_data(t.orders, None, "o_totalprice", order_by=["o_orderkey"]),
    """SELECT o_orderkey::VARCHAR AS label, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 20""",
)

register(
    "pie_other",
    lambda t: rounded(aggregates.pie_data(t.part, "p_brand", "p_retailprice"), "value"),
    """WITH s AS (SELECT p_brand AS name, sum(p_retailprice) AS v FROM part GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY v DESC, name) AS rn FROM s),
    u AS (SELECT name, v FROM k WHERE rn <= 10
      UNION ALL SELECT 'Other', sum(v) FROM k WHERE rn > 10 HAVING sum(v) > 0)
    SELECT name, round(v, 2) AS value, round(v / (SELECT sum(v) FROM s) * 100, 1) AS share_pct FROM u""",
)

register(
    "value_counts",
    lambda t: aggregates.value_counts(t.part, "p_name", 20),
    """SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, p_name LIMIT 20""",
)

register(
    "histogram",
    lambda t: aggregates.histogram(t.lineitem, "l_extendedprice", 20),
    """WITH f AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
        least(20, count(DISTINCT l_extendedprice)) AS n FROM lineitem),
    b AS (SELECT least(floor((l_extendedprice - lo) * n / (hi - lo)), n - 1)::INT AS bin, count(*) AS c
      FROM lineitem, f GROUP BY 1)
    SELECT g.bin::INT AS bin, round(lo + g.bin * (hi - lo) / n, 4) AS bin_start, coalesce(c, 0) AS count
    FROM f, (SELECT unnest(range(20)) AS bin) g LEFT JOIN b ON b.bin = g.bin WHERE g.bin < n""",
)

register(
    "histogram_few_values",
    lambda t: aggregates.histogram(t.lineitem, "l_linenumber", 20),
    """WITH f AS (SELECT min(l_linenumber)::DOUBLE AS lo, max(l_linenumber)::DOUBLE AS hi,
        least(20, count(DISTINCT l_linenumber)) AS n FROM lineitem),
    b AS (SELECT least(floor((l_linenumber - lo) * n / (hi - lo)), n - 1)::INT AS bin, count(*) AS c
      FROM lineitem, f GROUP BY 1)
    SELECT g.bin::INT AS bin, round(lo + g.bin * (hi - lo) / n, 4) AS bin_start, coalesce(c, 0) AS count
    FROM f, (SELECT unnest(range(20)) AS bin) g LEFT JOIN b ON b.bin = g.bin WHERE g.bin < n""",
)

register(
    "describe",
    lambda t: rounded(
        aggregates.describe(t.lineitem, "l_extendedprice"),
        "min",
        "max",
        "mean",
        "std",
        "p25",
        "p50",
        "p75",
        digits=4,
    ),
    """SELECT count(*) AS count, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max,
      round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
      round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
      round(quantile_cont(l_extendedprice, 0.75), 4) AS p75 FROM lineitem""",
)

register(
    "boxplot",
    lambda t: aggregates.boxplot_stats(t.events, "value", "event_type"),
    """WITH q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
        quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT g AS "group",
      round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS min,
      round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
      round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS max,
      round(avg(value), 4) AS mean, count(*) AS count
    FROM events JOIN q ON g = event_type GROUP BY g, q1, q2, q3""",
)

register(
    "boxplot_top_groups",
    lambda t: aggregates.boxplot_stats(t.part, "p_retailprice", "p_brand"),
    """WITH q AS (SELECT p_brand AS g, quantile_cont(p_retailprice, 0.25) AS q1,
        quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.75) AS q3
      FROM part GROUP BY 1 ORDER BY round(q2, 4) DESC, g LIMIT 15)
    SELECT g AS "group",
      round(min(p_retailprice) FILTER (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4)
        AS min,
      round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
      round(max(p_retailprice) FILTER (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4)
        AS max,
      round(avg(p_retailprice), 4) AS mean, count(*) AS count
    FROM part JOIN q ON g = p_brand GROUP BY g, q1, q2, q3""",
)


def outlier_sql(column: str, table: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER ({column} < lo OR {column} > hi) AS count,
      round(any_value(lo), 4) AS lower_fence, round(any_value(hi), 4) AS upper_fence,
      round(count(*) FILTER ({column} < lo OR {column} > hi) * 100 / count(*), 2) AS pct
    FROM {table}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
      (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {table}))"""


register(
    "iqr_outliers",
    lambda t: aggregates.iqr_outliers(t.events.select("value", "user_id")),
    outlier_sql("value", "events") + " UNION ALL " + outlier_sql("user_id", "events"),
)

register(
    "duplicates",
    lambda t: aggregates.duplicate_count(t.lineitem.select("l_orderkey", "l_linenumber")),
    """SELECT count(*) AS row_count,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
        AS duplicate_count FROM lineitem""",
)

# The same two over whole tables.
register(
    "iqr_outliers_whole_table",
    lambda t: aggregates.iqr_outliers(t.events),
    " UNION ALL ".join(outlier_sql(c, "events") for c in ("event_id", "user_id", "value")),
)

register(
    "duplicates_whole_rows",
    lambda t: aggregates.duplicate_count(t.lineitem.unionByName(t.lineitem.where(F.col("l_linenumber") == 1))),
    """WITH b AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
    SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS duplicate_count
    FROM b""",
)

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

register(
    "corr_pairs",
    lambda t: aggregates.correlation_pairs(t.lineitem, _NUM),
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS correlation FROM lineitem"
        for i, a in enumerate(_NUM)
        for b in _NUM[i + 1 :]
    ),
)

register(
    "corr_pairs_missing",
    lambda t: aggregates.correlation_pairs(
        t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"), "p_retailprice")
    ),
    """SELECT 'p_partkey' AS col_a, 'size' AS col_b, round(corr(p_partkey, nullif(p_size, 7)), 3) AS correlation
      FROM part
    UNION ALL SELECT 'p_partkey', 'p_retailprice', round(corr(p_partkey, p_retailprice), 3) FROM part
    UNION ALL SELECT 'size', 'p_retailprice', round(corr(nullif(p_size, 7), p_retailprice), 3) FROM part""",
)

register(
    "corr_matrix",
    lambda t: aggregates.correlation_matrix(t.lineitem, _NUM),
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", "
        + ", ".join(f"round(corr({a}, {b}), 3) AS {b}" for b in _NUM)
        + " FROM lineitem"
        for a in _NUM
    ),
)

_STRENGTH = """CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong'
  WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END"""

register(
    "target_corr",
    lambda t: aggregates.target_correlations(
        t.lineitem.withColumn(
            "net", F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_quantity")
        ).select("net", *_NUM),
        "net",
    ),
    "WITH n AS (SELECT *, l_extendedprice * (1 - l_discount) * l_quantity AS net FROM lineitem), c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr(net, {c}), 4) AS r FROM n" for c in _NUM)
    + f""") SELECT "column", r AS correlation, {_STRENGTH} AS strength,
      CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM c""",
)

# --- query specs ------------------------------------------------------------------------------

register(
    "spec_groupby",
    lambda t: rounded(
        run_query_spec(
            _flagged(t),
            {
                "operation": "groupby",
                "group_by": ["flag", "l_linestatus"],
                "aggregate": {"l_extendedprice": "sum", "l_quantity": "mean", "l_tax": "count"},
            },
        ),
        "l_extendedprice",
        "l_quantity",
    ),
    """SELECT nullif(l_returnflag, 'N') AS flag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice,
      round(avg(l_quantity), 2) AS l_quantity, count(l_tax) AS l_tax
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""",
)

register(
    "spec_top_n",
    lambda t: rounded(
        run_query_spec(
            t.orders,
            {
                "operation": "top_n",
                "group_by": ["o_custkey"],
                "aggregate": {"o_totalprice": "max"},
                "sort_ascending": True,
                "limit": 7,
            },
        ),
        "o_totalprice",
    ),
    """SELECT o_custkey, round(max(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1
    ORDER BY max(o_totalprice), o_custkey LIMIT 7""",
)

register(
    "spec_distribution_number",
    lambda t: rounded(
        run_query_spec(t.events, {"operation": "distribution", "columns": ["value"]}),
        "min",
        "max",
        "mean",
        "std",
        "p25",
        "p50",
        "p75",
        digits=4,
    ),
    """SELECT count(value) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max,
      round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
      round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
      round(quantile_cont(value, 0.75), 4) AS p75 FROM events""",
)

register(
    "spec_distribution_text",
    lambda t: run_query_spec(t.part, {"operation": "distribution", "columns": ["p_brand"]}),
    "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, p_brand LIMIT 10",
)

register(
    "spec_filter_contains",
    lambda t: run_query_spec(
        t.part,
        {
            "operation": "filter",
            "filter": {"column": "p_name", "operator": "contains", "value": "WIDGET"},
        },
        order_by=["p_partkey"],
    ),
    """SELECT *, (SELECT count(*) FROM part WHERE regexp_matches(p_name, 'widget', 'i')) AS match_count
    FROM part WHERE regexp_matches(p_name, 'widget', 'i') ORDER BY p_partkey LIMIT 20""",
)

register(
    "spec_timeseries",
    lambda t: run_query_spec(
        t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")),
        {"operation": "timeseries", "x_col": "o_orderdate", "y_col": "o_totalprice"},
    ),
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders",
)

register(
    "spec_correlation",
    lambda t: run_query_spec(
        t.part, {"operation": "correlation", "columns": ["p_partkey", "p_retailprice"]}
    ),
    """WITH c AS (SELECT corr(p_partkey, p_retailprice) AS r, count(*) AS pairs FROM part)
    SELECT 'p_partkey' AS col_a, 'p_retailprice' AS col_b, round(r, 3) AS correlation,
      CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
      CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, pairs FROM c""",
)

# --- comparisons ------------------------------------------------------------------------------


def segment_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", avg(v) FILTER (s = 1) AS m1, stddev_samp(v) FILTER (s = 1) AS s1,
      quantile_cont(v, 0.5) FILTER (s = 1) AS d1, count(v) FILTER (s = 1) AS n1,
      avg(v) FILTER (s = 2) AS m2, stddev_samp(v) FILTER (s = 2) AS s2,
      quantile_cont(v, 0.5) FILTER (s = 2) AS d2, count(v) FILTER (s = 2) AS n2
    FROM (SELECT {column}::DOUBLE AS v, CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS s
      FROM events WHERE event_type IN ('purchase', 'view'))"""


_SEGMENTS = (
    "WITH a AS ("
    + " UNION ALL ".join(segment_sql(c) for c in ("event_id", "user_id", "value"))
    + """), e AS (SELECT *, round((m1 - m2)
      / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 3) AS effect_size FROM a) """
)

register(
    "compare_segments",
    lambda t: rounded(
        compare.compare_segments(t.events, "event_type", " Purchase", "VIEW"),
        *[f"{v}{i}" for v in ("mean", "std", "median") for i in (1, 2)],
        digits=4,
    ),
    _SEGMENTS
    + """SELECT "column", round(m1, 4) AS mean1, round(s1, 4) AS std1, round(d1, 4) AS median1,
      round(m2, 4) AS mean2, round(s2, 4) AS std2, round(d2, 4) AS median2, n1 AS count1, n2 AS count2,
      effect_size, CASE WHEN effect_size > 0 THEN 'higher_in_val1' ELSE 'higher_in_val2' END AS direction
    FROM e""",
)

register(
    "notable_diffs",
    lambda t: compare.notable_diffs(
        t.lineitem.select("l_returnflag", F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 2)
            .otherwise(F.col("l_quantity")).alias("load"), "l_tax"),
        "l_returnflag",
        "A",
        "R",
    ),
    """WITH v AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS s,
        CASE WHEN l_returnflag = 'A' THEN l_quantity * 2 ELSE l_quantity END AS load FROM lineitem
        WHERE l_returnflag IN ('A', 'R')),
    a AS (SELECT avg(load) FILTER (s = 1) AS m1, avg(load) FILTER (s = 2) AS m2,
      var_samp(load) FILTER (s = 1) AS v1, var_samp(load) FILTER (s = 2) AS v2,
      count(*) FILTER (s = 1) AS n1, count(*) FILTER (s = 2) AS n2 FROM v)
    SELECT 'load' AS "column",
      round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 3) AS effect_size,
      'higher_in_val1' AS direction FROM a""",
)


def window_sql(s1: str, e1: str, s2: str, e2: str, n1: str, n2: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}) FILTER (o_orderdate >= DATE '{s1}'
          AND o_orderdate < DATE '{e1}' + 1), 4) AS p1_mean,
        round(avg({c}) FILTER (o_orderdate >= DATE '{s2}' AND o_orderdate < DATE '{e2}' + 1), 4) AS p2_mean,
        count(*) FILTER (o_orderdate >= DATE '{s1}' AND o_orderdate < DATE '{e1}' + 1) AS rows1,
        count(*) FILTER (o_orderdate >= DATE '{s2}' AND o_orderdate < DATE '{e2}' + 1) AS rows2
      FROM orders"""
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
    return f"""WITH a AS ({parts}),
    b AS (SELECT *, CASE WHEN abs(p1_mean) < 1e-10 THEN 0.0
      ELSE round((p2_mean - p1_mean) / abs(p1_mean) * 100, 1) END AS pct_change FROM a)
    SELECT "column", '{n1}' AS period1, '{n2}' AS period2, rows1, rows2, p1_mean, p2_mean, pct_change,
      CASE WHEN abs(pct_change) < 1 THEN 'flat' WHEN pct_change > 0 THEN 'up' ELSE 'down' END AS direction,
      abs(pct_change) >= 20 AS notable FROM b"""


register(
    "compare_windows",
    lambda t: compare.compare_time_windows(
        t.orders, "o_orderdate", ("spring", "1996-03-01", "1996-05-31"), ("autumn", "1998-09-01", "1998-11-30")
    ),
    window_sql("1996-03-01", "1996-05-31", "1998-09-01", "1998-11-30", "spring", "autumn"),
)

register(
    "compare_preset_years",
    lambda t: compare.compare_preset(t.orders, "o_orderdate", "1997 vs 1998"),
    window_sql("1997-01-01", "1997-12-31", "1998-01-01", "1998-12-31", "1997", "1998"),
)

_ENDS = """WITH e AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi, year(max(o_orderdate)) AS y
  FROM orders) """

_PERIODS = {
    "quarters": (
        "Q1 vs Q3 2000",
        """SELECT 'Q1 ' || y AS period1, y || '-01-01' AS start1, y || '-03-31' AS end1,
          'Q3 2000' AS period2, '2000-07-01' AS start2, '2000-09-30' AS end2 FROM e""",
    ),
    "h1h2": (
        "H1 vs H2",
        """SELECT 'H1 ' || y AS period1, y || '-01-01' AS start1, y || '-06-30' AS end1,
          'H2 ' || y AS period2, y || '-07-01' AS start2, y || '-12-31' AS end2 FROM e""",
    ),
    "yoy": (
        "yoy",
        """SELECT (y - 1)::VARCHAR AS period1, (y - 1) || '-01-01' AS start1, (y - 1) || '-12-31' AS end1,
          y::VARCHAR AS period2, y || '-01-01' AS start2, y || '-12-31' AS end2 FROM e""",
    ),
    "mom": (
        "mom",
        """SELECT strftime(m - INTERVAL 1 MONTH, '%b %Y') AS period1,
          strftime(m - INTERVAL 1 MONTH, '%Y-%m-%d') AS start1,
          strftime(m - INTERVAL 1 DAY, '%Y-%m-%d') AS end1, strftime(m, '%b %Y') AS period2,
          strftime(m, '%Y-%m-%d') AS start2, strftime(last_day(m), '%Y-%m-%d') AS end2
        FROM (SELECT date_trunc('month', hi)::DATE AS m FROM e)""",
    ),
    "halves": (
        "halves",
        """SELECT strftime(lo, '%b %Y') || ' – ' || strftime(mid, '%b %Y') AS period1,
          strftime(lo, '%Y-%m-%d') AS start1, strftime(mid - INTERVAL 1 DAY, '%Y-%m-%d') AS end1,
          strftime(mid, '%b %Y') || ' – ' || strftime(hi, '%b %Y') AS period2,
          strftime(mid, '%Y-%m-%d') AS start2, strftime(hi, '%Y-%m-%d') AS end2
        FROM (SELECT lo, hi, make_timestamp((epoch_us(lo) + epoch_us(hi)) // 2) AS mid FROM e)""",
    ),
}
for _name, (_preset, _sql) in _PERIODS.items():
    register(
        f"period_{_name}",
        lambda t, preset=_preset: compare.period_bounds(t.orders, "o_orderdate", preset),
        _ENDS + _sql,
    )


register(
    "bar_median",
    lambda t: rounded(
        aggregates.bar_data(
            relational.apply_filter(t.lineitem, [{"column": "l_quantity", "operator": "gt", "value": 10}]),
            "l_linenumber",
            "l_extendedprice",
            "median",
        ),
        "value",
        digits=4,
    ),
    """SELECT l_linenumber::VARCHAR AS label, round(quantile_cont(l_extendedprice, 0.5), 4) AS value
    FROM lineitem WHERE l_quantity > 10 GROUP BY 1""",
)

