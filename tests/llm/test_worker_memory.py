import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from framewise.llm import parity_join, words

DOCS = "doc_id long, text string"


def sentence(start, n=60):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_word_runs_hold_little_at_a_time(monkeypatch):
    monkeypatch.setattr(words, "_powers", words._Powers())
    column = pa.array([sentence(i, 400) for i in range(3_000)])
    tracemalloc.start()
    try:
        found = sum(len(s) for s in parity_join.shingle_sets(column, 5))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 3_000 * 396
    assert column.nbytes > 5e6 and most < 50e6


def test_copies_in_one_task_give_their_keys_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        docs = spark.createDataFrame([(i, sentence(0)) for i in range(40)], DOCS).coalesce(1)
        signed = parity_join.set_signatures(docs, 5, 8, 10)
        assert signed.where(F.size("keys") > 0).count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_row_without_id_takes_no_links_from_its_copies(spark):
    near = sentence(0) + " end"
    rows = [(None, sentence(0)), (5, sentence(0)), (3, near), (9, sentence(500))]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, DOCS).coalesce(1), 5, 8, 10)
    assert {r.doc_id: r.component_id for r in got.collect()} == {None: None, 5: 3, 3: 3, 9: 9}


def test_pairs_are_compared_in_portions_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "PORTION", 2)
    taken = []
    similar = parity_join._similar
    monkeypatch.setattr(parity_join, "_similar", lambda pairs, *rest: taken.append(pairs.count()) or similar(pairs, *rest))
    rows = [(i, sentence(0) + f" end{i}") for i in range(16)] + [(99, sentence(500))]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, DOCS), 5, 8, 10)
    assert {r.doc_id: r.component_id for r in got.collect()} == {**dict.fromkeys(range(16), 0), 99: 99}
    assert len(taken) > 1 and max(taken) < sum(taken)
