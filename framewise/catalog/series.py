"""Rankings, time series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.base import LINEITEM_KEY, Tables, register
from framewise.catalog.grouping import rounded
from framewise.operators import timeseries


def _daily(t: Tables):
    return rounded(timeseries.daily_totals(t.orders, "o_orderdate", "o_totalprice"), "o_totalprice")


def _day_text(df, *names: str):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


DAILY = """(SELECT o_orderdate::DATE AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)"""

register(
    "top_n_orders",
    lambda t: _day_text(
        timeseries.top_n(t.orders, "o_totalprice", 25, tie_break=["o_orderkey"]), "o_orderdate"
    ),
    """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS _rank, o_totalprice, o_orderkey,
      o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
    FROM orders ORDER BY _rank LIMIT 25""",
)

register(
    "bottom_n_lineitem",
    lambda t: timeseries.top_n(
        t.lineitem,
        "l_quantity",
        80,
        ascending=True,
        display_cols=["l_orderkey", "l_quantity", "l_tax"],
        tie_break=LINEITEM_KEY,
    ),
    """SELECT row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _rank,
      l_quantity, l_orderkey, l_tax FROM lineitem ORDER BY _rank LIMIT 50""",
)

register(
    "top_n_missing",
    lambda t: timeseries.top_n(
        t.part.withColumn("size", F.nullif("p_size", F.lit(50))),
        "size",
        15,
        display_cols=["p_partkey"],
        tie_break=["p_partkey"],
    ),
    """SELECT row_number() OVER (ORDER BY nullif(p_size, 50) DESC, p_partkey) AS _rank,
      nullif(p_size, 50) AS size, p_partkey FROM part WHERE p_size <> 50 ORDER BY _rank LIMIT 15""",
)

register(
    "rolling_avg",
    lambda t: _day_text(
        timeseries.rolling_average(_daily(t), ["o_orderdate"], "o_totalprice"), "o_orderdate"
    ),
    f"""SELECT strftime(d, '%Y-%m-%d') AS o_orderdate, v AS o_totalprice,
      round(avg(v) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_avg FROM {DAILY}""",
)

register(
    "rolling_avg_by_key",
    lambda t: timeseries.rolling_average(
        t.events.select(
            "event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.sqrt("value")).alias("value")
        ),
        ["event_id"],
        "value",
        window=12,
        key=["event_type"],
    ),
    """SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN sqrt(value) END AS value,
      round(avg(CASE WHEN event_id % 5 <> 0 THEN sqrt(value) END) OVER (PARTITION BY event_type ORDER BY event_id
        ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 4) AS rolling_avg FROM events""",
)

register(
    "trend",
    lambda t: _day_text(
        timeseries.linear_trend(
            _daily(t).withColumn("o_totalprice", F.col("o_totalprice") / 1000), ["o_orderdate"], "o_totalprice"
        ),
        "o_orderdate",
    ),
    f"""WITH p AS (SELECT d, v / 1000 AS v, row_number() OVER (ORDER BY d) - 1 AS i FROM {DAILY}),
    l AS (SELECT regr_slope(v, i) AS m, regr_intercept(v, i) AS b FROM p)
    SELECT strftime(d, '%Y-%m-%d') AS o_orderdate, v AS o_totalprice, round(m * i + b, 4) AS trend FROM p, l""",
)

_POINTS = """WITH p AS (SELECT o_orderdate, sqrt(o_totalprice) AS o_totalprice, o_custkey,
    row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
  s AS (SELECT *, CASE WHEN n > 500 THEN n // 500 ELSE 1 END AS step FROM p),
  k AS (SELECT o_orderdate, o_totalprice, o_custkey, i // step AS j FROM s WHERE i % step = 0) """


def _roots(t: Tables):
    return t.orders.withColumn("o_totalprice", F.sqrt("o_totalprice"))


register(
    "timeseries",
    lambda t: _day_text(
        timeseries.timeseries(_roots(t), "o_orderdate", "o_totalprice", tie_break=["o_orderkey"]),
        "o_orderdate",
    ),
    _POINTS
    + """, l AS (SELECT regr_slope(o_totalprice, j) AS m, regr_intercept(o_totalprice, j) AS b FROM k)
    SELECT j AS point, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice,
      round(avg(o_totalprice) OVER (ORDER BY j ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_avg,
      round(m * j + b, 4) AS trend FROM k, l""",
)

register(
    "overlay",
    lambda t: _day_text(
        timeseries.overlay(
            _roots(t), "o_orderdate", ["o_totalprice", "o_custkey"], tie_break=["o_orderkey"]
        ),
        "o_orderdate",
    ),
    _POINTS
    + """SELECT j AS point, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, o_custkey FROM k""",
)

register(
    "thin",
    lambda t: timeseries.thin(t.events.select("event_id", "value"), ["event_id"], 300),
    """WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i,
      count(*) OVER () AS n FROM events)
    SELECT event_id, value FROM p WHERE i % CASE WHEN n > 300 THEN n // 300 ELSE 1 END = 0""",
)

register(
    "frequency",
    lambda t: timeseries.detect_frequency(t.orders, "o_orderdate"),
    """WITH g AS (SELECT date_diff('day', lag(o_orderdate) OVER (ORDER BY o_orderdate), o_orderdate) AS gap
      FROM orders), m AS (SELECT quantile_cont(gap, 0.5) AS median_gap FROM g)
    SELECT median_gap, CASE WHEN median_gap <= 1.5 THEN 'day' WHEN median_gap <= 8 THEN 'week'
        WHEN median_gap <= 45 THEN 'month' ELSE 'quarter' END AS period_label,
      CASE WHEN median_gap <= 1.5 THEN 1 WHEN median_gap <= 8 THEN 7 ELSE round_even(median_gap, 0)::INT END
        AS step_days FROM m""",
)

register(
    "frequency_by_key",
    lambda t: timeseries.detect_frequency(
        t.lineitem.withColumn("l_shipdate", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz"))
        .select("l_returnflag", "l_shipdate")
        .distinct(),
        "l_shipdate",
        ["l_returnflag"],
    ),
    """WITH m AS (SELECT DISTINCT l_returnflag, date_trunc('month', l_shipdate) AS d FROM lineitem),
    g AS (SELECT l_returnflag, date_diff('day', lag(d) OVER (PARTITION BY l_returnflag ORDER BY d), d) AS gap
      FROM m), q AS (SELECT l_returnflag, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY 1)
    SELECT l_returnflag, median_gap, CASE WHEN median_gap <= 1.5 THEN 'day' WHEN median_gap <= 8 THEN 'week'
        WHEN median_gap <= 45 THEN 'month' ELSE 'quarter' END AS period_label,
      CASE WHEN median_gap <= 1.5 THEN 1 WHEN median_gap <= 8 THEN 7 ELSE round_even(median_gap, 0)::INT END
        AS step_days FROM q""",
)

register(
    "first_last_change",
    lambda t: timeseries.first_last_change(t.orders, ["o_orderdate", "o_orderkey"], "o_totalprice"),
    """WITH e AS (SELECT arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_value,
      arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_value FROM orders)
    SELECT first_value, last_value, round((last_value - first_value) / abs(first_value) * 100, 1) AS pct_change
    FROM e""",
)


def _forecast(t: Tables):
    return _day_text(timeseries.forecast(_daily(t), "o_orderdate", "o_totalprice", 12), "date")


register("forecast_daily", _forecast)

register(
    "forecast_by_segment",
    lambda t: _day_text(
        timeseries.forecast(
            t.lineitem.groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(
                F.sum("l_quantity").alias("qty")
            ),
            "day",
            "qty",
            6,
            key=["l_returnflag"],
        ),
        "date",
    ),
)
