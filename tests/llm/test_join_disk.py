"""What the Jaccard join keeps on disk while it runs."""

import pytest

from framewise.llm import parity_join, storage


def test_keys_are_not_stored_and_shuffle_files_go_at_once(spark, monkeypatch):
    seen = []
    store = parity_join.stored

    def watched(df, folder=None):
        seen.append((df.columns, spark.conf.get(storage.CLEANUP_CONF)))
        return store(df, folder)

    monkeypatch.setattr(parity_join, "stored", watched)
    before = spark.conf.get(storage.CLEANUP_CONF)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, " ".join(words)), (4, "other words"), (5, None)]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert seen and all("keys" not in columns and removed == "true" for columns, removed in seen)
    assert spark.conf.get(storage.CLEANUP_CONF) == before


def test_setting_is_restored_after_an_error(spark):
    before = spark.conf.get(storage.CLEANUP_CONF)
    with pytest.raises(ValueError), storage.shuffles_removed(spark):
        raise ValueError
    assert spark.conf.get(storage.CLEANUP_CONF) == before
