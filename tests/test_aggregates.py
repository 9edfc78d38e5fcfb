import pytest
from collected import rows
from pyspark.sql import functions as F

from framewise.functions.quantiles import group_percentiles
from framewise.functions.scale import is_small, row_positions
from framewise.operators import aggregates, compare


@pytest.fixture
def sales(table):
    return table(
        "region string, product string, revenue double, units long, cost double",
        [
            ("East", "A", 100.0, 10, 60.0),
            ("East", "B", 230.0, 20, 80.0),
            ("West", "A", 200.0, 5, 90.0),
            ("West", "B", 300.0, 15, 100.0),
            ("North", "A", 250.0, 8, 70.0),
            (None, "B", None, 1, None),
        ],
    )


def test_group_stats(sales):
    got = [tuple(r) for r in aggregates.group_stats(sales, "region", ["revenue"]).collect()]
    assert got == [("West", 500.0), ("East", 330.0), ("North", 250.0), (None, None)]
    counts = aggregates.group_stats(sales, "region", agg="count").collect()
    assert [tuple(r) for r in counts] == [("East", 2), ("West", 2), ("North", 1), (None, 1)]
    assert aggregates.group_stats(sales, "region", ["revenue"], "nonsense").first().revenue == 500.0
    assert aggregates.group_stats(sales.select("region", "product"), "region").columns == ["region", "count"]
    assert aggregates.group_stats(sales, "region", ["revenue"], "median").first().revenue == 250.0
    with pytest.raises(ValueError):
        aggregates.group_stats(sales, "nope")


def test_share(sales):
    first = aggregates.group_total(sales, "region", "revenue").first()
    assert (first.region, first.total, first.share_pct) == ("West", 1080.0, 46.3)
    assert aggregates.group_total(sales, "region", "revenue", "median").first().total == 230.0


def test_spec_groupby_drops_missing_keys(sales):
    got = aggregates.spec_groupby(sales, ["region"], {"units": "sum"}, ascending=True)
    assert [tuple(r) for r in got.collect()] == [("North", 8), ("West", 20), ("East", 30)]
    with pytest.raises(ValueError):
        aggregates.spec_groupby(sales, ["region"], {"units": "median"})


def test_crosstab(sales):
    wide = aggregates.crosstab(sales, "region", "product", "revenue")
    assert rows(wide) == [("East", 100.0, 230.0), ("North", 250.0, 0.0), ("West", 200.0, 300.0)]
    capped = aggregates.crosstab_cells(sales, "region", "product", agg="count", max_rows=2, max_cols=1)
    assert rows(capped) == [("East", "A", 1), ("North", "A", 1)]
    totals = {(r.kind, r.label): r.total for r in aggregates.crosstab_totals(sales, "region", "product", "revenue", "mean").collect()}
    assert totals[("grand", "all")] == 1080.0 and totals[("column", "B")] == 530.0
    with pytest.raises(ValueError):
        aggregates.crosstab_cells(sales, "region", "product", agg="mode")


def test_pie_rolls_the_tail_up(spark):
    df = spark.range(12).select(F.concat(F.lit("s"), F.col("id")).alias("s"), (F.col("id") + 1).cast("double").alias("v"))
    got = {r.name: (r.value, r.share_pct) for r in aggregates.pie_data(df, "s", "v", 10).collect()}
    assert len(got) == 11 and got["Other"] == (3.0, 3.8)
    negative = df.withColumn("v", F.when(F.col("v") <= 2, -F.col("v")).otherwise(F.col("v")))
    assert "Other" not in {r.name for r in aggregates.pie_data(negative, "s", "v", 10).collect()}


def test_histogram_edges(table, spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    got = aggregates.histogram(df, "v", 10).collect()
    assert [r["count"] for r in got] == [10] * 9 + [11]
    constant = aggregates.histogram(spark.range(5).select(F.lit(3.0).alias("v")), "v", 10).collect()
    assert [(r.bin_start, r["count"]) for r in constant] == [(2.5, 5)]
    odd = table("v double", [(1.0,), (float("nan"),), (float("inf"),), (None,), (2.0,)])
    assert sum(r["count"] for r in aggregates.histogram(odd, "v").collect()) == 2
    assert aggregates.histogram(odd.where("v is null"), "v").count() == 0


def test_boxplot_and_outliers(table):
    df = table("g string, v double", [("a", float(x)) for x in [1, 2, 3, 4, 100]] + [("b", 5.0), (None, 9.0)])
    got = {r.group: r for r in aggregates.boxplot_stats(df, "v", "g").collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3, got["a"].max, got["a"]["count"]) == (2.0, 3.0, 4.0, 4.0, 5)
    assert (got["b"].min, got["b"].max) == (5.0, 5.0)
    assert aggregates.boxplot_stats(df, "v").first()["count"] == 7
    few = table("v double", [(1.0,), (2.0,), (900.0,)])
    assert tuple(aggregates.iqr_outliers(few).first()) == ("v", 0, None, None, 0.0)


def test_duplicates_count_nulls_as_equal(table):
    df = table("a long, b string", [(1, None), (1, None), (1, None), (2, "x")])
    assert rows(aggregates.duplicate_count(df)) == [(4, 2)]
    assert rows(aggregates.duplicate_count(df.limit(0))) == [(0, 0)]


def test_correlations(table):
    df = table(
        "units double, revenue double, discount double, flat double",
        [(float(i), float(2 * i), float(-i), 1.0) for i in range(9)] + [(None, 3.0, 1.0, 1.0)],
    )
    top = aggregates.target_correlations(df, "revenue").collect()
    assert {(r.column, r.direction, r.strength) for r in top} == {
        ("units", "positive", "very strong"), ("discount", "negative", "very strong"),
    }
    matrix = {r.column: r for r in aggregates.correlation_matrix(df).collect()}
    assert matrix["units"].revenue == 1.0 and matrix["revenue"].units == 1.0 and matrix["flat"].units is None
    with pytest.raises(ValueError):
        aggregates.correlation_pairs(df.select("units"))


def test_segments(table):
    east = [("East ", 100.0 + i, 1.0) for i in range(4)]
    west = [("west", 10.0 + i, 1.0) for i in range(4)]
    df = table("region string, revenue double, flat double", east + west)
    got = {r.column: r for r in compare.compare_segments(df, "region", "EAST", "West").collect()}
    assert got["revenue"].direction == "higher_in_val1" and got["revenue"].effect_size > 10
    assert got["flat"].effect_size == 0.0
    assert [r.column for r in compare.notable_diffs(df, "region", "east", "west").collect()] == ["revenue"]
    single = compare.compare_segments(df.where("revenue in (100, 10)"), "region", "east", "west")
    assert {r.column: r.effect_size for r in single.collect()}["revenue"] == 9.0


def test_time_windows(table):
    rows_ = [(f"2023-0{m}-15", 100.0, 0.0) for m in range(1, 5)] + [(f"2024-0{m}-15", 150.0, 5.0) for m in range(1, 5)]
    df = table("date string, revenue double, zero double", rows_ + [("junk", 1e9, 1.0)])
    got = {r.column: r for r in compare.compare_preset(df, "date", "2023 vs 2024").collect()}
    assert (got["revenue"].pct_change, got["revenue"].direction, got["revenue"].notable) == (50.0, "up", True)
    assert (got["zero"].pct_change, got["zero"].direction) == (0.0, "flat")
    assert compare.compare_time_windows(df, "date", ("a", "2000-01-01", "2000-12-31"), ("b", "2024-01-01", "2024-12-31")).count() == 0
    with pytest.raises(ValueError):
        compare.period_bounds(df, "date", "whenever")


HOT = "CASE WHEN id % 3 = 0 THEN 5.0 ELSE (id * 7919 % 1000) / 10.0 END"


@pytest.mark.parametrize("n", [1, 2, 5, 997, 30_011])
def test_percentiles_agree_with_the_built_in(spark, large_plans, n):
    df = spark.range(n).selectExpr(f"{HOT} AS v", "CASE WHEN id % 5 < 2 THEN 'hot' ELSE 'g' || id % 7 END AS g")
    assert not is_small(df)
    probabilities = {"lo": 0.001, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p9": 0.999, "min": 0.0, "max": 1.0}
    want = df.groupBy("g").agg(
        *[F.round(F.percentile("v", F.lit(p)), 9).alias(k) for k, p in probabilities.items()]
    )
    got = group_percentiles(df, ["g"], "v", probabilities)
    got = got.select("g", *[F.round(k, 9).alias(k) for k in probabilities])
    assert rows(got) == rows(want)
    whole = group_percentiles(df, [], "v", {"q": 0.37}).first().q
    assert whole == pytest.approx(df.agg(F.percentile("v", F.lit(0.37))).first()[0])


def test_percentiles_of_small_inputs(spark):
    df = spark.range(1000).selectExpr(f"{HOT} AS v", "id % 3 AS g")
    want = df.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("q"))
    got = group_percentiles(df, ["g"], "v", {"q": 0.9})
    assert {r.g: r.q for r in got.collect()} == pytest.approx({r.g: r.q for r in want.collect()})


@pytest.mark.parametrize("parts", [1, 13])
def test_positions_equal_row_numbers(spark, large_plans, parts):
    df = spark.range(4000).selectExpr("id", "id * 7 % 3 AS k", "CASE WHEN id % 3 = 0 THEN 1 ELSE id * 31 % 500 END AS o")
    got = row_positions(df.repartition(parts), [F.col("o"), F.col("id")], "p", ["k"])
    want: dict[int, int] = {}
    seen: dict[int, int] = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.o, r.id)):
        want[r.id] = seen.get(r.k, 0)
        seen[r.k] = want[r.id] + 1
    assert {r.id: r.p for r in got.collect()} == want
    whole = row_positions(df, [F.col("o").desc(), F.col("id")], "p")
    assert [r.p for r in whole.orderBy(F.desc("o"), "id").collect()] == list(range(4000))
