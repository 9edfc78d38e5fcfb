import pytest
from collected import rows
from pyspark.sql import functions as F

from framewise.operators import joins, relational
from framewise.plans.cleaning import clean
from framewise.plans.query_spec import run_query_spec

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def sales(table):
    return table(
        "id long, region string, category string, revenue double, units long, status string",
        [
            (1, "North", "A", 100.0, 1, "active"),
            (2, "north", "B", 200.0, 2, "inactive"),
            (3, "South", "A", 300.0, 3, "active"),
            (4, None, "C", None, 4, None),
            (5, "East", "B", 500.0, 5, "active"),
        ],
    )


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("column", "op", "value", "expected"),
    [
        ("region", "eq", "NORTH", [1, 2]),
        ("region", "ne", "north", [3, 4, 5]),
        ("revenue", "gt", 200, [3, 5]),
        ("revenue", "gte", "200", [2, 3, 5]),
        ("units", "lt", 2.5, [1, 2]),
        ("units", "lte", 2, [1, 2]),
        ("units", "eq", 3, [3]),
        ("units", "eq", "3", []),
        ("units", "ne", "3", [1, 2, 3, 4, 5]),
        ("region", "contains", "TH", [1, 2, 3]),
        ("region", "not_contains", "th", [4, 5]),
        ("region", "notcontains", "th", [4, 5]),
        ("region", "gt", 1, []),
    ],
)
def test_filter_operators(sales, column, op, value, expected):
    condition = [{"column": column, "operator": op, "value": value}]
    assert ids(relational.apply_filter(sales, condition)) == expected


def test_filter_skips_or_reports_bad_conditions(sales):
    bad = [
        {"column": "nope", "operator": "eq", "value": 1},
        {"column": "region", "operator": "like", "value": 1},
        {"column": "units", "operator": "gt", "value": "many"},
        {"column": "region", "operator": "contains", "value": "("},
    ]
    assert ids(relational.apply_filter(sales, bad)) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="not in dataset"):
        relational.apply_filter(sales, bad[:1], strict=True)
    assert len(relational.validate_conditions(bad, sales.columns)) == 2


def test_filter_reaches_the_scan(spark, tmp_path, sales):
    sales.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = relational.apply_filter(df, [{"column": "units", "operator": "gt", "value": 2}])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(units,2)" in text


def test_filter_stats_and_view(sales):
    condition = [{"column": "status", "operator": "eq", "value": "active"}]
    assert rows(relational.filter_stats(sales, condition)) == [(5, 3, 40.0)]
    relational.set_view(sales, "t_view", condition)
    assert ids(relational.active_view(sales, "t_view")) == [1, 3, 5]
    relational.clear_view(sales.sparkSession, "t_view")
    assert ids(relational.active_view(sales, "t_view")) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [("gt", 250, [1, 2, 4]), ("eq", 100.0, [2, 3, 4, 5]), ("ne", 100.0, [1])],
)
def test_remove_rows_keeps_missing_except_ne(sales, op, value, expected):
    assert ids(relational.remove_rows(sales, "revenue", op, value)) == expected


def test_remove_rows_text(sales):
    assert ids(relational.remove_rows(sales, "region", "contains", "th")) == [4, 5]
    assert ids(relational.remove_rows(sales, "region", "notcontains", "th")) == [1, 2, 3]
    with pytest.raises(ValueError):
        relational.remove_rows(sales, "region", "like", "x")


def test_computed_columns(sales):
    df = relational.add_computed_column(sales, "per_unit", "revenue / (units - 1)")
    assert [r.per_unit for r in df.orderBy("id").collect()] == [None, 200.0, 150.0, None, 125.0]
    assert relational.add_computed_column(sales, "units", "units ** 2").orderBy("id").first().units == 1.0
    assert relational.add_computed_column(sales, "one", "1").first().one == 1
    assert rows(relational.preview_computed_column(sales, "big", "units > 3", 2, ["id"]), 1) == [
        (False,),
        (False,),
    ]
    for name, expr in (("2x", "units"), ("x", ""), ("x", "nope + 1"), ("x", "sum(units)"), ("x", "(select 1)")):
        with pytest.raises(ValueError):
            relational.add_computed_column(sales, name, expr)
    assert sales.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"


def test_rename_and_drop(sales):
    assert "area" in relational.rename_column(sales, "region", "area").columns
    for old, new in (("nope", "x"), ("region", "a b"), ("region", ""), ("region", "units")):
        with pytest.raises(ValueError):
            relational.rename_column(sales, old, new)
    assert "units" not in relational.drop_column(sales, "units").columns
    with pytest.raises(ValueError):
        relational.drop_column(sales, "nope")


def test_records_are_paged_and_clamped(sales):
    page = relational.sample_records(sales, n=2, offset=1, order_by=["id"])
    assert [r.id for r in page.collect()] == [2, 3]
    assert relational.sample_records(sales, n=0, order_by=["id"]).count() == 1
    assert relational.sample_records(sales, n=900).count() == 5


def test_parse_dates(table):
    df = table(
        "id long, d string",
        [(1, "2024-01-05"), (2, "01/06/2024"), (3, "junk"), (4, None), (5, "2024/01/07"), (6, "2024"),
         (7, "2024-01-08 10:20:30")],
    )
    got = [r.d and r.d.strftime("%Y-%m-%d") for r in relational.parse_dates(df, "d").orderBy("id").collect()]
    assert got == ["2024-01-05", "2024-01-06", None, None, "2024-01-07", None, "2024-01-08"]


def test_samples_do_not_depend_on_layout(spark):
    df = spark.range(5000).select("id", (F.col("id") * 2).alias("y"))
    a = relational.sample_rows(df.repartition(1), ["id"], 50).collect()
    b = relational.sample_rows(df.repartition(17), ["id"], 50).collect()
    assert a == b
    scatter = relational.scatter_sample(df, "id", "y", ["id"], 100)
    assert scatter.count() == 100 and scatter.first().r == 1.0


def merge_tables(table):
    left = table("id long, name string, revenue long", [(1, "a", 10), (2, "b", 20), (3, "c", 30)])
    right = table("id long, score double, revenue long", [(2, 0.5, 7), (3, 0.6, 8), (4, 0.7, 9)])
    return left, right


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 3), ("right", 3), ("outer", 4)])
def test_merge(table, how, n):
    left, right = merge_tables(table)
    got = joins.merge(left, right, "id", how)
    assert got.columns == ["id", "name", "revenue_left", "score", "revenue_right"]
    assert got.count() == n
    assert got.where("id is null").count() == 0


def test_merge_rejects_bad_requests(table):
    left, right = merge_tables(table)
    with pytest.raises(ValueError):
        joins.merge(left, right, "id", "cross")
    with pytest.raises(ValueError):
        joins.merge(left, right, "name")
    assert joins.conflict_columns(left, right, "id") == ["revenue"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_missing_keys_match_with_a_hot_key(table, how):
    left = table("k long, a long", [(None, i) for i in range(3)] + [(7, i) for i in range(40)] + [(1, 1)])
    right = table("k long, b long", [(None, 1), (7, 2), (7, 3), (9, 4)])
    got = joins.merge(left, right, "k", how)
    matched = 3 + 80
    extra = {"inner": 0, "left": 1, "right": 1, "outer": 2}[how]
    assert got.count() == matched + extra
    assert joins.merge(left, right, "k", how, null_safe=False).where("a is not null and b is not null").count() == 80


def test_join_suggestions(table):
    left = table("id long, value long", [(1, 5), (2, 5), (3, 5)])
    right = table("id long, score double", [(1, 0.1), (2, 0.2), (2, 0.3)])
    (row,) = joins.suggest_join_keys(left, right).collect()
    assert (row.name, row.unique_left, row.unique_right, row.uniqueness_right, row.recommended) == (
        "id", 3, 2, 0.667, True,
    )


def test_clean_requests(table):
    df = table("revenue double, region string, quantity double", [(1.0, "a", 1.0), (1.0, "a", 1.0), (None, "b", None)])
    assert clean(df, {"operation": "remove_duplicates"}).count() == 2
    assert clean(df, {"operation": "drop_column", "column": "region"}).columns == ["revenue", "quantity"]
    assert clean(df, {"operation": "fill_missing", "column": "revenue", "strategy": "zero"}).where(
        "revenue = 0"
    ).count() == 1
    for request in ({"operation": "nope"}, {"operation": "fill_missing", "column": "revenue"}):
        with pytest.raises(ValueError):
            clean(df, request)


def test_query_spec_errors(sales):
    for spec in ({"operation": "x"}, {"operation": "groupby", "group_by": ["nope"]}, {"operation": "distribution"},
                 {"operation": "correlation", "columns": ["region", "units"]}):
        with pytest.raises(ValueError):
            run_query_spec(sales, spec)
    unknown = {"operation": "filter", "filter": {"column": "units", "operator": "~", "value": 1}}
    assert run_query_spec(sales, unknown).first().match_count == 5
