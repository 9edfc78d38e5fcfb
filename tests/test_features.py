import pytest
from collected import rows

from framewise.operators import cleaning, features
from framewise.plans.features import add_step, apply_transforms, remove_step


@pytest.fixture
def gaps(table):
    return table(
        "id long, v double, n long, s string",
        [(1, 1.0, 2, "b"), (2, None, None, None), (3, 3.0, 4, "a"), (4, 8.0, 4, "b"), (5, 8.0, 2, "a")],
    )


@pytest.mark.parametrize(
    ("column", "strategy", "value", "expected"),
    [
        ("v", "mean", None, 5.0),
        ("v", "median", None, 5.5),
        ("v", "mode", None, 8.0),
        ("n", "mode", None, 2),
        ("s", "mode", None, "a"),
        ("v", "zero", None, 0.0),
        ("v", "value", 7, 7.0),
        ("s", "value", "none", "none"),
    ],
)
def test_fill(gaps, column, strategy, value, expected):
    filled = cleaning.fill_missing(gaps, column, strategy, value)
    assert filled.columns == gaps.columns
    assert filled.where("id = 2").first()[column] == expected


def test_fill_errors(gaps, table):
    for args in (("s", "mean"), ("v", "value"), ("v", "best"), ("nope", "zero")):
        with pytest.raises(ValueError):
            cleaning.fill_missing(gaps, *args)
    empty = table("v double", [(None,), (None,)])
    assert cleaning.fill_missing(empty, "v", "mode").first().v == 0.0
    assert cleaning.fill_report(gaps, "v", "mean").first().modified_count == 1


def test_cap(spark, table):
    df = spark.range(101).selectExpr("CAST(id AS DOUBLE) AS v")
    capped = [r.v for r in cleaning.cap_outliers(df, "v", 95).orderBy("v").collect()]
    assert capped[0] == 5.0 and capped[-1] == 95.0 and len(capped) == 101
    report = cleaning.cap_report(df, "v", 95).first()
    assert (report.lower_bound, report.upper_bound, report.modified_count) == (5.0, 95.0, 10)
    missing = table("v double", [(1.0,), (None,), (3.0,)])
    assert [r.v for r in cleaning.cap_outliers(missing, "v", 20).collect()] == [2.0, None, 2.0]
    with pytest.raises(ValueError):
        cleaning.cap_outliers(table("s string", [("a",)]), "s")


def test_reports(gaps):
    after = cleaning.fill_missing(gaps, "v", "zero")
    assert cleaning.changed_rows(gaps, after, ["id"], "v").first().modified_count == 1
    assert tuple(cleaning.cleaning_report(gaps, gaps.limit(2).drop("s"), "x").first())[1:] == (5, 2, 3, 4, 3)


def test_date_parts(table):
    df = table("d string", [("2024-01-06",), ("2024-01-08",), ("junk",), (None,)])
    got = [tuple(r)[1:] for r in features.date_decompose(df, "d").collect()]
    assert got == [(2024, 1, 5, 1), (2024, 1, 0, 0), (None, None, None, 0), (None, None, None, 0)]


def test_log(table):
    df = table("v double", [(0.0,), (-5.0,), (None,), (1.718281828459045,)])
    assert [r.v_log for r in features.log_transform(df, "v").collect()] == [0.0, 0.0, None, pytest.approx(1.0)]


def test_quartiles(table):
    df = table("v double", [(float(i),) for i in range(1, 9)] + [(None,)])
    got = [r.v_quartile for r in features.bin_quartile(df, "v").orderBy("v").collect()]
    assert got == ["nan", "Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4"]
    with pytest.raises(ValueError):
        features.bin_quartile(table("v double", [(1.0,)] * 7 + [(2.0,)]), "v")


def test_encoders(gaps):
    hot = features.one_hot(gaps.select("id", "s"), "s")
    assert hot.columns == ["id", "s", "s_MISSING", "s_a", "s_b"]
    assert rows(hot.select("s_MISSING", "s_a", "s_b").where("id = 2")) == [(1, 0, 0)]
    coded = features.label_encode(gaps, "s")
    assert [r.s_encoded for r in coded.orderBy("id").collect()] == [1, -1, 0, 1, 0]


def test_steps(gaps):
    steps = add_step([{"column": "v__n", "transform_type": "interaction"}], {"column": "s", "transform_type": "one_hot"})
    df, made = apply_transforms(gaps, [*steps, {"column": "zz", "transform_type": "log_transform"},
                                       {"column": "v", "transform_type": "magic"}])
    assert made == {"v__n": ["v_x_n"], "s": ["s_MISSING", "s_a", "s_b"]}
    assert df.where("id = 3").first().v_x_n == 12.0
    assert remove_step(steps, 0) == steps[1:]
    with pytest.raises(ValueError):
        remove_step(steps, 5)


def test_suggestions(spark):
    df = spark.range(60).selectExpr(
        "CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS STRING) AS day", "exp(id / 5.0) AS amount",
        "'c' || id % 3 AS colour", "'s' || id % 20 AS sku", "'u' || id AS name", "id % 4 AS stars",
        "CAST(id AS DOUBLE) AS a", "CAST(2 * id AS DOUBLE) AS b"
    )
    got = [(r.column, r.transform_type) for r in features.suggest_features(df).orderBy("rank").collect()]
    assert got[:5] == [("day", "date_decompose"), ("amount", "log_transform"), ("amount", "bin_quartile"),
                       ("a", "bin_quartile"), ("b", "bin_quartile")]
    assert ("colour", "one_hot") in got and ("sku", "label_encode") in got and ("stars", "one_hot") in got
    assert ("a__b", "interaction") in got and not any(c == "name" for c, _ in got)


def test_problem_types(spark):
    df = spark.range(100).selectExpr("id % 2 = 0 AS flag", "'t' || id % 3 AS t", "rand() AS f", "id % 10 AS few", "id AS many")
    kinds = {c: features.detect_problem_type(df, c).first().problem_type for c in df.columns}
    assert kinds == {"flag": "classification", "t": "classification", "f": "regression", "few": "classification",
                     "many": "regression"}
    assert features.target_classes(df, "few").count() == 10


def test_mutual_information_ranks_the_driver_first(spark):
    df = spark.range(2000).selectExpr("IF(id % 10 < 5, 'a', 'b') AS y", "id % 10 AS x", "id * 7919 % 1009 AS noise",
                                      "IF(id % 10 < 4, 'k', 'l') AS near")
    got = features.feature_importance_mi(df, "y").orderBy("rank").collect()
    assert [r.column for r in got] == ["x", "near", "noise"]
    assert got[0].importance == pytest.approx(0.6931, abs=1e-4)
    assert sum(r.importance_pct for r in got) == pytest.approx(100, abs=0.2)
