import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import timeseries


def test_top_n(table):
    df = table("product string, sales double", [("a", 5.0), ("b", None), ("c", 7.0), ("d", None), ("e", 7.0)])
    top = timeseries.top_n(df, "sales", 2, tie_break=["product"]).collect()
    assert [(r._rank, r.product, r.sales) for r in top] == [(1, "c", 7.0), (2, "e", 7.0)]
    assert timeseries.top_n(df, "sales", 0).count() == 1
    assert [r.product for r in timeseries.top_n(df, "sales", 99, ascending=True, tie_break=["product"]).collect()] == ["a", "c", "e"]
    wide = df.select("*", *[F.lit(i).alias(f"c{i}") for i in range(12)])
    assert len(timeseries.top_n(wide, "sales").columns) == 9
    with pytest.raises(ValueError):
        timeseries.top_n(df, "product")


def expected_rolling(values, window):
    n = len(values)
    size = max(2, min(window, n // 3)) if n >= 6 else 1
    out = []
    for i in range(n):
        part = [v for v in values[max(0, i - size + 1) : i + 1] if v is not None]
        out.append(round(sum(part) / len(part), 4) if part else None)
    return out


@pytest.mark.parametrize("n", [1, 5, 6, 10, 40])
def test_rolling_average(table, n):
    values = [None if i % 4 == 1 else float(i * i % 13) for i in range(n)]
    df = table("i long, v double", list(enumerate(values)))
    got = timeseries.rolling_average(df.repartition(5), ["i"], "v").orderBy("i").collect()
    assert [r.rolling_avg for r in got] == pytest.approx(expected_rolling(values, 7), abs=1e-4)


def test_rolling_average_across_chunks(spark, monkeypatch, large_plans):
    real = timeseries.with_halo
    monkeypatch.setattr(timeseries, "with_halo", lambda df, p, reach: real(df, p, reach, chunk=50))
    df = spark.range(1000).selectExpr("id", "id % 3 AS k", "CAST(id * 37 % 101 AS DOUBLE) AS v")
    got = timeseries.rolling_average(df, ["id"], "v", 9, key=["k"]).collect()
    assert len(got) == 1000
    for k in range(3):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.id)
        assert [r.rolling_avg for r in mine] == pytest.approx(expected_rolling([r.v for r in mine], 9), abs=1e-4)


def test_trend_skips_missing_values(table):
    df = table("i long, v double", [(0, 1.0), (1, None), (2, 5.0), (3, 7.0)])
    assert [r.trend for r in timeseries.linear_trend(df, ["i"], "v").orderBy("i").collect()] == [1.0, 3.0, 5.0, 7.0]
    lone = timeseries.linear_trend(df.limit(1), ["i"], "v").first()
    assert lone.trend is None


def test_thin_keeps_every_step(spark):
    df = spark.range(1234).select("id")
    assert [r.id for r in timeseries.thin(df, ["id"], 500).collect()] == list(range(0, 1234, 2))
    assert timeseries.thin(df.limit(100), ["id"], 500).count() == 100


def test_timeseries_and_overlay(spark):
    df = spark.range(30).selectExpr(
        "CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS STRING) AS day", "CAST(200 + 5 * id AS DOUBLE) AS v", "id AS w"
    ).union(spark.sql("SELECT 'junk', 1.0D, 1L"))
    points = timeseries.timeseries(df, "day", "v").collect()
    assert len(points) == 30 and points[0].trend == 200.0 and points[29].rolling_avg == 330.0
    both = timeseries.overlay(df, "day", ["v", "w"]).collect()
    assert both[3].v == 215.0 and both[3].w == 3


@pytest.mark.parametrize(("step", "label", "days"), [(1, "day", 1), (7, "week", 7), (31, "month", 31), (92, "quarter", 92)])
def test_frequency(spark, step, label, days):
    df = spark.range(8).selectExpr(f"date_add(DATE'2024-01-01', CAST(id AS INT) * {step}) AS d", "id % 2 AS k")
    row = timeseries.detect_frequency(df, "d").first()
    assert (row.period_label, row.step_days) == (label, days)
    assert timeseries.detect_frequency(df, "d", ["k"]).count() == 2


def test_change(table):
    df = table("i long, v double", [(1, None), (2, 4.0), (3, 9.0), (4, 5.0), (5, None)])
    assert tuple(timeseries.first_last_change(df, ["i"], "v").first()) == (4.0, 5.0, 25.0)


def oracle_forecast(dates, values, future):
    def features(ds, start):
        return np.array([
            [start + i, np.sin(2 * np.pi * d.month / 12), np.cos(2 * np.pi * d.month / 12),
             np.sin(2 * np.pi * d.weekday() / 7), np.cos(2 * np.pi * d.weekday() / 7)]
            for i, d in enumerate(ds)
        ])

    x, y = features(dates, 0), np.array(values)
    beta = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    const = y.mean() - x.mean(0) @ beta
    half = 1.96 * np.std(y - x @ beta - const, ddof=1)
    p = features(future, len(dates)) @ beta + const
    return p, half


@pytest.mark.parametrize("step", [1, 7, 30])
def test_forecast_matches_least_squares(spark, step):
    df = spark.range(60).selectExpr(
        f"date_add(DATE'2023-01-05', CAST(id AS INT) * {step}) AS d", "CAST(1000 + 50 * id + 20 * (id % 3) AS DOUBLE) AS v"
    )
    data = sorted((r.d, r.v) for r in df.collect())
    got = timeseries.forecast(df, "d", "v", 5).orderBy("step").collect()
    p, half = oracle_forecast([d for d, _ in data], [v for _, v in data], [r.date for r in got])
    assert [r.value for r in got] == pytest.approx(list(p), rel=1e-6)
    assert got[0].upper - got[0].value == pytest.approx(half, rel=1e-4)
    assert got[0].trend == "up"
    assert (got[0].date.date() - data[-1][0]).days == step


def test_forecast_limits(spark):
    df = spark.range(30).selectExpr(
        "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day", "200 + 5 * id AS sales", "'k' || id % 2 AS k",
    )
    exact = timeseries.forecast(df, "day", "sales", 99).orderBy("step").collect()
    assert len(exact) == 24 and exact[0].value == 350.0 and exact[0].lower == 350.0
    assert timeseries.forecast(df.limit(3), "day", "sales").count() == 0
    keyed = timeseries.forecast(df, "day", "sales", 2, key=["k"], include_history=True)
    assert keyed.count() == 34 and keyed.where("kind = 'forecast'").count() == 4
