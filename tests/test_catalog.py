"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = connect(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["kmeans", "anomaly_counts", "train_linear", "cv", "forecast_by_segment", "scatter_sample"])
def test_query_without_sql_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_contract(spark):
    assert entry(spark).count() == 3
    assert set(oracle_sql()) <= set(queries())
