import pytest
from pyspark.sql import functions as F

from framewise.operators import profile, quality
from framewise.plans.story import best_category, data_story, next_step


@pytest.fixture
def clean(spark):
    return spark.range(300).selectExpr(
        "rand(1) * 100 AS revenue", "id % 17 AS quantity", "'r' || id % 4 AS region", "'p' || id % 5 AS product"
    )


def test_column_stats(table):
    df = table("a double, b string", [(1.0, "x"), (None, "y"), (None, None), (3.0, "x"), (5.0, "z")])
    got = {r.column: r for r in profile.column_stats(df).collect()}
    assert (got["a"].null_count, got["a"].null_pct, got["a"].unique_count, got["a"]["mean"], got["a"]["std"]) == (
        2, 40.0, 3, 3.0, 2.0,
    )
    assert (got["b"].null_count, got["b"].sample_values, got["b"]["min"]) == (1, ["x", "y", "z"], None)
    empty = {r.column: r for r in profile.column_stats(df.limit(0)).collect()}
    assert (empty["a"].row_count, empty["a"].null_pct, empty["a"].unique_count) == (0, 0.0, 0)


def test_nan_counts_as_missing(table):
    from framewise.functions.columns import normalize_missing

    df = normalize_missing(table("a double", [(float("nan"),), (float("inf"),), (1.0,)]))
    assert profile.column_stats(df).first().null_count == 2


def test_insights(table):
    rows = [(f"id{i}", float(i), float(2 * i), "2024-01-01", None if i < 4 else 1.0) for i in range(10)]
    df = table("code string, a double, b double, day string, gap double", rows + [rows[0]])
    found = {(r.type, r.column): r.severity for r in profile.insights(df).collect()}
    assert found[("missing_values", "gap")] == "warning"
    assert found[("correlation", "a,b")] == "info"
    assert found[("duplicates", "*")] == "warning"
    assert ("date_column", "day") in found and ("high_cardinality", "code") not in found
    unique = {(r.type, r.column) for r in profile.insights(df.limit(10).dropDuplicates()).collect()}
    assert ("high_cardinality", "code") in unique


def issues(row):
    return {i.type: i.severity for i in row.issues}


def test_numeric_profile_issues(spark):
    df = spark.range(1, 101).selectExpr("id", "CASE WHEN id > 98 THEN 1000.0 ELSE 1.0 END AS tail", "7 AS flat",
                                         "CASE WHEN id > 40 THEN id END AS holes")
    assert issues(profile.column_profile(df, "id").first()) == {"potential_id": "info"}
    assert issues(profile.column_profile(df, "tail").first()) == {"skewed": "info"}
    assert issues(profile.column_profile(df, "flat").first()) == {"constant_value": "warning"}
    assert issues(profile.column_profile(df, "holes").first())["high_null_rate"] == "warning"
    row = profile.column_profile(df, "id").first()
    assert (row.median, row.p25, row.p75, row.skewness) == (50.5, 25.75, 75.25, 0.0)


def test_categorical_profile_issues(spark):
    df = spark.range(100).selectExpr("'v' || id AS wide", "IF(id < 95, 'a', 'b') AS most", "'x' AS one", "'k' || id % 3 AS k")
    assert issues(profile.column_profile(df, "wide").first()) == {"high_cardinality": "warning"}
    assert issues(profile.column_profile(df, "most").first()) == {"dominant_value": "info"}
    assert issues(profile.column_profile(df, "one").first()) == {"constant_value": "warning"}
    row = profile.column_profile(df, "k").first()
    assert (row.most_common, row.most_common_pct, row.unique_count) == ("k0", 34.0, 3)
    narrow = df.limit(40).selectExpr("wide")
    assert issues(profile.column_profile(narrow, "wide").first()) == {"near_unique": "info"}


@pytest.mark.parametrize(
    ("step", "label"), [(1, "daily"), (7, "weekly"), (30, "monthly"), (91, "quarterly"), (365, "annual")]
)
def test_date_profile(spark, step, label):
    df = spark.range(12).selectExpr(f"CAST(date_add(DATE'2024-01-01', CAST(id AS INT) * {step}) AS STRING) AS order_date")
    row = profile.column_profile(df, "order_date").first()
    assert (row.col_type, row.estimated_frequency, row.date_range_days) == ("date", label, 11 * step)


def test_gaps_match_a_plain_sort(spark):
    df = spark.range(500).selectExpr(
        "CAST(TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id * id % 211 AS INT), CAST(id % 24 AS INT)) "
        "AS TIMESTAMP_NTZ) AS t"
    )
    times = sorted(r.t for r in df.collect())
    gaps = sorted((b - a).days for a, b in zip(times, times[1:]))
    got = []
    for r in profile.day_gaps(df, "t").collect():
        got += [r.gap] * r.weight
    assert sorted(got) == gaps


def test_date_detection(spark):
    df = spark.range(20).selectExpr(
        "id", "'t' || id AS label", "CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS STRING) AS booked",
        "IF(id < 10, 'x', '2024-01-01') AS half", "'2024-02-02' AS fixed_day"
    )
    assert {r.column for r in profile.detect_time_columns(df).collect()} >= {"booked", "fixed_day"}
    assert "label" not in {r.column for r in profile.detect_time_columns(df).collect()}
    assert profile.pick_date_column(df).first().column == "booked"
    assert profile.pick_date_column(df.select("label", "half")).count() == 0


def test_readiness_of_clean_data(clean):
    row = quality.readiness(clean).first()
    assert (row.score, row.grade, row.status) == (95, "A", "ready")


def test_readiness_scores(table, spark):
    tiny = table("a double, b string", [(None, "x")] * 10)
    got = {r.component: (r.score, r.status) for r in quality.readiness_components(tiny).collect()}
    assert got == {
        "row_count": (0, "critical"), "missing_values": (5, "critical"), "duplicate_rows": (5, "critical"),
        "feature_diversity": (10, "warning"), "type_quality": (5, "critical"),
    }
    empty = {r.component: r.score for r in quality.readiness_components(tiny.limit(0)).collect()}
    assert empty == {"row_count": 0, "missing_values": 0, "duplicate_rows": 20, "feature_diversity": 10, "type_quality": 0}
    wide = spark.range(50).selectExpr("'a' || id AS a", "'b' || id AS b", "id")
    assert quality.type_quality_score(wide).first().score == 8
    assert quality.type_quality_score(wide.select("a", "id")).first().score == 11
    for schema, expected in (("a double", 0), ("a string, b string", 5), ("a double, d date", 8), ("a int, b int, c int", 12)):
        assert quality.diversity_score(table(schema, [])).first().score == expected


@pytest.mark.parametrize(("ones", "status"), [(96, "critical"), (85, "warning"), (60, "good")])
def test_class_balance(spark, ones, status):
    df = spark.range(100).selectExpr(f"IF(id < {ones}, 'a', 'b') AS y", "id")
    assert quality.class_balance(df, "y").first().status == status
    assert quality.class_balance(df, "id").count() == 0


def test_roles_and_dictionary(spark):
    df = spark.range(100).selectExpr(
        "id AS customer_id", "rand(1) AS revenue", "'r' || id % 4 AS region", "'2024-01-01' AS signup_date",
        "id % 2 = 0 AS is_new", "repeat('long text ', 10) || id % 50 AS comments", "id % 5 AS stars", "CAST(id AS STRING) AS thing"
    )
    roles = {r.column: r.col_type for r in quality.data_dictionary(df).collect()}
    assert roles == {
        "customer_id": "id", "revenue": "metric", "region": "dimension", "signup_date": "date", "is_new": "flag",
        "comments": "text", "stars": "dimension", "thing": "id",
    }
    texts = {r.column: r.description for r in quality.data_dictionary(df).collect()}
    assert texts["region"].endswith("4 distinct values.")


def test_model_readiness(table):
    runs = table(
        "id string, algorithm string, problem_type string, status string, is_selected boolean, r2 double, accuracy double",
        [("a", "x", "regression", "done", True, 0.9, None), ("b", "x", "classification", "done", False, None, 0.7),
         ("c", "x", "regression", "failed", True, 0.9, None), ("d", "x", "regression", "done", False, None, None)],
    )
    data = table("v double", [(1.0,)] * 60)
    got = {r.id: (r.score, r.verdict) for r in quality.model_readiness(runs, data, 1).collect()}
    assert got == {"a": (80, "needs_attention"), "b": (55, "not_ready"), "d": (40, "not_ready")}


def test_story(clean):
    assert best_category(clean) == "product"
    rows = data_story(clean.withColumn("id", F.monotonically_increasing_id()), ["id"], "revenue").collect()
    assert {r.section for r in rows} == {"readiness", "breakdown", "drivers", "anomalies"}
    assert next_step(clean).first().next_step == "set_target"
    assert next_step(clean.limit(3), "revenue").first().next_step != "set_target"
