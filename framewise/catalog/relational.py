"""Filters, projections, joins, sampling and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.base import LINEITEM_KEY, Tables, register
from framewise.operators import joins, relational
from framewise.sources import tables as sources

LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _gappy_parts(t: Tables):
    """Parts with missing types and sizes."""
    return t.part.withColumns(
        {
            "p_type": F.nullif("p_type", F.lit("PROMO")),
            "p_size": F.nullif("p_size", F.lit(7)),
        }
    )


GAPPY = """(SELECT p_partkey, p_name, p_brand, nullif(p_type, 'PROMO') AS p_type,
    nullif(p_size, 7) AS p_size, p_retailprice FROM part)"""

register(
    "filter_and",
    lambda t: relational.apply_filter(
        t.customer,
        [
            {"column": "c_mktsegment", "operator": "eq", "value": "building"},
            {"column": "c_acctbal", "operator": "gte", "value": 1000},
            {"column": "c_nationkey", "operator": "ne", "value": 3},
            {"column": "no_such_column", "operator": "eq", "value": 1},
        ],
    ),
    """SELECT * FROM customer
    WHERE lower(c_mktsegment) = 'building' AND c_acctbal >= 1000 AND c_nationkey <> 3""",
)

register(
    "filter_contains",
    lambda t: relational.apply_filter(
        _gappy_parts(t),
        [
            {"column": "p_name", "operator": "contains", "value": "RED|small"},
            {"column": "p_type", "operator": "not_contains", "value": "econ"},
        ],
    ),
    f"""SELECT * FROM {GAPPY}
    WHERE regexp_matches(p_name, 'RED|small', 'i')
      AND NOT coalesce(regexp_matches(p_type, 'econ', 'i'), false)""",
)

register(
    "filter_missing_ne",
    lambda t: relational.apply_filter(
        _gappy_parts(t), [{"column": "p_type", "operator": "ne", "value": "Economy"}]
    ),
    f"SELECT * FROM {GAPPY} WHERE NOT coalesce(lower(p_type) = 'economy', false)",
)

register(
    "filter_text_as_number",
    lambda t: relational.apply_filter(
        t.orders.withColumn("rating", F.substring("o_orderpriority", 1, 1)),
        [{"column": "rating", "operator": "lte", "value": 2}],
    ),
    """SELECT *, substr(o_orderpriority, 1, 1) AS rating FROM orders
    WHERE try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) <= 2""",
)

register(
    "filter_stats",
    lambda t: relational.filter_stats(
        t.lineitem,
        [
            {"column": "l_returnflag", "operator": "eq", "value": "r"},
            {"column": "l_quantity", "operator": "gt", "value": 25},
        ],
    ),
    """SELECT count(*) AS original_rows,
      count(*) FILTER (lower(l_returnflag) = 'r' AND l_quantity > 25) AS filtered_rows,
      round((count(*) - count(*) FILTER (lower(l_returnflag) = 'r' AND l_quantity > 25)) * 100.0
        / count(*), 1) AS reduction_pct FROM lineitem""",
)


def _active_view(t: Tables):
    relational.set_view(
        t.customer, "framewise_customer_view", [{"column": "c_acctbal", "operator": "lt", "value": 0}]
    )
    kept = relational.active_view(t.customer, "framewise_customer_view")
    relational.clear_view(kept.sparkSession, "framewise_customer_view")
    return kept


register("active_view", _active_view, "SELECT * FROM customer WHERE c_acctbal < 0")

register(
    "remove_rows_lt",
    lambda t: relational.remove_rows(_gappy_parts(t), "p_size", "lt", 25),
    f"SELECT * FROM {GAPPY} WHERE NOT coalesce(p_size < 25, false)",
)

register(
    "remove_rows_ne",
    lambda t: relational.remove_rows(_gappy_parts(t), "p_type", "ne", "LARGE"),
    f"SELECT * FROM {GAPPY} WHERE NOT coalesce(p_type <> 'LARGE', true)",
)

register(
    "remove_rows_contains",
    lambda t: relational.remove_rows(_gappy_parts(t), "p_type", "contains", "a"),
    f"SELECT * FROM {GAPPY} WHERE NOT coalesce(regexp_matches(p_type, 'a', 'i'), false)",
)

register(
    "spec_filter",
    lambda t: relational.spec_filter(
        t.orders, "o_totalprice", ">", 400000, order_by=["o_orderkey"]
    ).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")),
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
      (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS match_count
    FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 20""",
)

register(
    "rename_drop",
    lambda t: relational.drop_column(
        relational.rename_column(t.supplier, "s_acctbal", "balance"), "s_name"
    ),
    "SELECT s_suppkey, s_nationkey, s_acctbal AS balance FROM supplier",
)

register(
    "computed_column",
    lambda t: relational.add_computed_column(
        relational.add_computed_column(
            t.lineitem.select(*LINEITEM_KEY, "l_extendedprice", "l_discount", "l_tax", "l_quantity"),
            "net",
            "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7)",
        ),
        "per_discount",
        "round(l_quantity / l_discount, 4)",
    ),
    f"""SELECT {LI}, l_extendedprice, l_discount, l_tax, l_quantity,
      round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS net,
      CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 4) END AS per_discount
    FROM lineitem""",
)

register(
    "computed_preview",
    lambda t: relational.preview_computed_column(
        t.orders, "high_value", "o_totalprice > 250000", n=5, order_by=["o_orderkey"]
    ),
    "SELECT o_totalprice > 250000 AS high_value FROM orders ORDER BY o_orderkey LIMIT 5",
)

register(
    "records_page",
    lambda t: relational.sample_records(
        t.lineitem.drop("l_shipdate"),
        n=30,
        conditions=[{"column": "l_returnflag", "operator": "eq", "value": "A"}],
        offset=60,
        order_by=LINEITEM_KEY,
    ),
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
    FROM lineitem WHERE lower(l_returnflag) = 'a' ORDER BY {LI} LIMIT 30 OFFSET 60""",
)

register(
    "parse_dates",
    lambda t: relational.parse_dates(
        t.orders.select(
            "o_orderkey",
            F.when(F.col("o_orderstatus") == "P", F.lit("not a date"))
            .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM/dd/yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .alias("day"),
        ),
        "day",
    ).withColumn("day", F.date_format("day", "yyyy-MM-dd")),
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day
    FROM orders""",
)

register(
    "dedupe",
    lambda t: relational.remove_duplicates(
        t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_linestatus", "l_quantity")
    ),
    """SELECT DISTINCT nullif(l_returnflag, 'N') AS flag, l_linestatus, l_quantity FROM lineitem""",
)

register(
    "dedupe_whole_rows",
    lambda t: relational.remove_duplicates(t.lineitem.unionByName(t.lineitem.where(F.col("l_linenumber") == 1))),
    "SELECT DISTINCT * FROM lineitem",
)

register(
    "normalize_missing",
    lambda t: sources.normalize_missing(
        t.part.select(
            "p_partkey",
            F.when(F.col("p_size") < 10, F.lit(float("nan")))
            .when(F.col("p_size") < 20, F.lit(float("inf")))
            .when(F.col("p_size") < 30, F.lit(float("-inf")))
            .otherwise(F.col("p_retailprice"))
            .alias("price"),
        )
    ),
    "SELECT p_partkey, CASE WHEN p_size >= 30 THEN p_retailprice END AS price FROM part",
)

register(
    "preview",
    lambda t: sources.preview(t.customer, 10, ["c_custkey"]),
    "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
)


def _extract(t: Tables):
    t.orders.createOrReplaceTempView("framewise_orders")
    return sources.extract_select(
        t.orders.sparkSession,
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total "
        "FROM framewise_orders GROUP BY o_orderpriority",
    )


register(
    "extract_select",
    _extract,
    """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_orderpriority""",
)


def _flat_diff(t: Tables):
    diff = sources.schema_diff(
        t.orders.sparkSession,
        t.orders.columns,
        t.orders.withColumn("o_clerk", F.lit("x")).drop("o_orderpriority"),
        required=["o_totalprice", "o_orderpriority"],
    )
    counts = t.orders.agg(F.count(F.lit(1)).alias("row_count"))
    flat = diff.select(
        F.concat_ws(",", "new_columns").alias("new_columns"),
        F.concat_ws(",", "removed_columns").alias("removed_columns"),
        F.concat_ws(",", "feature_columns_missing").alias("feature_columns_missing"),
        "compatible",
    )
    return flat.crossJoin(counts)


register(
    "schema_diff",
    _flat_diff,
    """SELECT 'o_clerk' AS new_columns, 'o_orderpriority' AS removed_columns,
      'o_orderpriority' AS feature_columns_missing, false AS compatible, count(*) AS row_count FROM orders""",
)



def _new_orders(t: Tables):
    """Orders of the even keys with another type, gaps, a new column and one column less."""
    return t.orders.where(F.col("o_orderkey") % 2 == 0).select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_custkey") % 3 == 0, F.lit("x")).alias("o_clerk"),
    )


register(
    "table_comparison",
    lambda t: sources.compare_tables(t.orders, _new_orders(t)),
    """WITH o AS (SELECT count(*) AS n FROM orders), e AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
    m AS (SELECT count(*) AS n, round(count(*) FILTER (o_orderkey % 4 <> 0) * 100.0 / count(*), 2) AS s,
      round(count(*) FILTER (o_custkey % 3 <> 0) * 100.0 / count(*), 2) AS c FROM e),
    v(name, status, differs, a, b) AS (VALUES ('o_orderkey', 'kept', false, 'bigint', 'bigint'), ('o_custkey', 'kept', false, 'bigint', 'bigint'),
      ('o_orderstatus', 'kept', false, 'string', 'string'), ('o_totalprice', 'kept', true, 'double', 'string'),
      ('o_orderdate', 'kept', false, 'timestamp_ntz', 'timestamp_ntz'), ('o_orderpriority', 'removed', false, 'string', NULL), ('o_clerk', 'added', false, NULL, 'string'))
    SELECT name AS "column", status, differs AS type_differs, a AS old_type, b AS new_type, CASE WHEN a IS NOT NULL THEN 0.0::DOUBLE END AS old_missing_pct,
      (CASE name WHEN 'o_orderstatus' THEN s WHEN 'o_clerk' THEN c ELSE CASE WHEN b IS NOT NULL THEN 0.0 END END)::DOUBLE AS new_missing_pct,
      CASE WHEN a IS NOT NULL THEN o.n END AS old_rows, CASE WHEN b IS NOT NULL THEN m.n END AS new_rows FROM v, o, m""",
)

# --- joins ------------------------------------------------------------------------------------


def _join_sides(t: Tables):
    """Orders and customers on ``custkey`` with a clashing ``nation`` and missing keys on both sides."""
    left = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("custkey"),
        F.col("o_orderstatus").alias("nation"),
    )
    right = t.customer.select(
        F.nullif("c_custkey", F.lit(1)).alias("custkey"),
        "c_name",
        F.col("c_nationkey").alias("nation"),
    )
    return left, right


JOIN_SQL = """WITH l AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS custkey,
    o_orderstatus AS nation FROM orders),
  r AS (SELECT nullif(c_custkey, 1) AS custkey, c_name, c_nationkey AS nation
    FROM customer)
  SELECT o_orderkey, {key} AS custkey, l.nation AS nation_left, c_name, r.nation AS nation_right
  FROM l {how} JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey"""

for _how, _sql_how, _key in (
    ("inner", "INNER", "l.custkey"),
    ("left", "LEFT", "l.custkey"),
    ("right", "RIGHT", "r.custkey"),
    ("outer", "FULL", "coalesce(l.custkey, r.custkey)"),
):
    register(
        f"merge_{_how}",
        lambda t, how=_how: joins.merge(*_join_sides(t), "custkey", how),
        JOIN_SQL.format(how=_sql_how, key=_key),
    )

register(
    "join_key_suggestions",
    lambda t: joins.suggest_join_keys(
        t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")),
        t.lineitem.select(
            F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("custkey"), "l_tax"
        ),
    ),
    """WITH s AS (
      SELECT 'orderkey' AS name, (SELECT count(DISTINCT o_orderkey) FROM orders) AS unique_left,
        (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS unique_right
      UNION ALL
      SELECT 'custkey', (SELECT count(DISTINCT o_custkey) FROM orders),
        (SELECT count(DISTINCT l_suppkey) FROM lineitem)),
    u AS (SELECT *, unique_left / (SELECT count(*) FROM orders) AS ul,
        unique_right / (SELECT count(*) FROM lineitem) AS ur FROM s)
    SELECT name, 'bigint' AS dtype_left, 'bigint' AS dtype_right, unique_left, unique_right,
      round(ul, 3) AS uniqueness_left, round(ur, 3) AS uniqueness_right,
      ul > 0.5 OR ur > 0.5 AS recommended FROM u""",
)

# --- samples ----------------------------------------------------------------------------------

register(
    "scatter_sample",
    lambda t: relational.scatter_sample(t.lineitem, "l_quantity", "l_extendedprice", LINEITEM_KEY),
)
