"""Benchmark items that are very long, or stand under very many ids."""

import time

import plain

from framewise.llm import decontamination


def test_one_repeated_word_and_one_text_of_many_ids(spark):
    text = plain.prose(4, 20)
    items = [("rep", "na " * 200_000), *[(f"i{k}", text) for k in range(10_000)]]
    docs = [(1, "x " + "na " * 14 + "y"), (2, f"z {text} z"), (3, "na na na"), (4, None)]
    start = time.perf_counter()
    got = decontamination.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()}
    assert found == {1: (16, 14, 1), 2: (22, 20, 10_000), 3: (3, 0, 0), 4: (0, 0, 0)}
    assert time.perf_counter() - start < 90
