import random

import numpy as np
import pandas as pd
import pytest

from framewise.functions import gram
from framewise.operators import aggregates


def frame(n, c, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1.0, (n, c))
    x[:, 1] = x[:, 0] * 3 + rng.normal(0, 0.1, n)
    x[:, 2] = 7.3
    data = pd.DataFrame(x, columns=[f"c{i}" for i in range(c)])
    random.seed(seed)
    for k in range(c):
        if k != 2:
            data.loc[rng.random(n) < 0.2 * (k % 3), f"c{k}"] = None
    data["c3"] = None
    data.loc[:4, "c4"], data.loc[5:, "c4"] = 5.5, None  # constant where it is known
    return data.astype(float)


def close(got, want):
    return (got is None and (want is None or np.isnan(want))) or (got is not None and abs(got - want) < 1e-6)


@pytest.mark.parametrize("block", [gram.BLOCK, 7])
def test_pairs_equal_plain_correlations(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    data = frame(700, 20)
    schema = ", ".join(f"{c} double" for c in data.columns)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    names = list(data.columns)
    want = data.corr()
    found = {(r["i"], r["j"]): r for r in gram.pair_correlations(df, names, names).collect()}
    assert len(found) == 400
    for (i, j), r in found.items():
        a, b = data[names[i]], data[names[j]]
        assert r["pairs"] == int((a.notna() & b.notna()).sum())
        both = data[[names[i], names[j]]].dropna()
        still = i != j and (len(both) == 0 or both.iloc[:, 0].nunique() < 2 or both.iloc[:, 1].nunique() < 2)
        assert close(r["r"], None if still or names[i] in ("c2", "c3", "c4") else want.iloc[i, j]), (i, j, r["r"])


def test_few_and_many_pairs_agree(spark, monkeypatch):
    data = frame(300, 6)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data.columns))
    few = [tuple(r) for r in aggregates.correlation_pairs(df).collect()]
    matrix = sorted(map(tuple, aggregates.correlation_matrix(df).collect()))
    target = [tuple(r) for r in aggregates.target_correlations(df, "c0").collect()]
    monkeypatch.setattr(aggregates, "PAIRS_PER_PASS", 1)
    assert [tuple(r) for r in aggregates.correlation_pairs(df).collect()] == few
    assert sorted(map(tuple, aggregates.correlation_matrix(df).collect())) == matrix
    assert [tuple(r) for r in aggregates.target_correlations(df, "c0").collect()] == target


def test_many_columns_take_one_scan(spark, tmp_path):
    names = [f"c{i}" for i in range(300)]
    rng = np.random.default_rng(5)
    spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 300)), columns=names)).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    pairs = aggregates.correlation_pairs(df)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert pairs.count() == 300 * 299 // 2


def test_values_that_are_not_finite_and_no_rows(spark):
    rows = [(1.0, 2.0, None), (2.0, float("nan"), 1.0), (3.0, 5.0, 2.0), (4.0, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["i"], r["j"]): r["r"] for r in gram.pair_correlations(df, ["a"], ["b", "c"]).collect()}
    assert np.isnan(found[0, 0]) and abs(found[0, 1] - 0.9819805060619659) < 1e-12
    assert gram.pair_correlations(df.limit(0), ["a"], ["b"]).collect() == []
