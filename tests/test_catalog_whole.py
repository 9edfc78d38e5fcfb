"""Catalogue queries take whole tables and the operators' default parameters."""

import inspect
import os

import pytest

from __spark_entry__ import queries
from framewise.operators import mining, ml

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
TRAINING = [
    "train_logistic", "train_forest_classifier", "train_boosting_classifier", "train_boosting_multiclass",
    "train_neural_network", "train_many", "importance", "tune", "cv", "cv_stratified",
]


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", TRAINING)
def test_training_has_default_parameters(spark, monkeypatch, name):
    def spy(function):
        signature = inspect.signature(function)

        def asked(*args, **kwargs):
            given = signature.bind(*args, **kwargs).arguments
            raise Asked({k: v for k, v in given.items() if k in ("params", "n_iter", "folds", "k", "base")})

        return asked

    for function in ("train", "train_many", "tune", "cross_validate"):
        monkeypatch.setattr(ml, function, spy(getattr(ml, function)))
    with pytest.raises(Asked) as said:
        queries()[name](spark, FOLDER)
    assert said.value.args == ({},)


def test_clusters_use_all_columns(spark, monkeypatch):
    def asked(df, columns=None, k=None):
        raise Asked(mining._usable(df, columns))

    monkeypatch.setattr(mining, "clusters", asked)
    with pytest.raises(Asked) as said:
        queries()["kmeans_auto"](spark, FOLDER)
    assert said.value.args == (["s_suppkey", "s_nationkey", "s_acctbal"],)


def test_profile_has_every_section_and_column(spark):
    rows = queries()["full_profile_whole_table"](spark, FOLDER).select("section", "column").distinct().collect()
    assert {"stats", "outliers", "correlation", "distribution"} <= {r.section for r in rows}
    assert set(spark.read.parquet(f"{FOLDER}/events.parquet").columns) <= {r.column for r in rows}


def test_story_has_target_and_anomalies(spark):
    rows = queries()["data_story_whole"](spark, FOLDER).select("section").distinct().collect()
    assert {r.section for r in rows} == {"readiness", "breakdown", "drivers", "anomalies"}
