"""The whole pipeline on documents whose fate at each stage is known."""

import hashlib

import plain
import pytest

import corpus_pipeline
from framewise.llm import queries

sentencepiece = pytest.importorskip("sentencepiece")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder, docs, items):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], plain.DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_takes_effect(spark, tmp_path):
    folder = str(tmp_path)
    good = {i: plain.prose(i, 90 + i % 40) for i in range(80)}
    words = good[3].split(" ")
    long_item, short_item = plain.prose(900, 30), plain.prose(901, 13)
    key = hashlib.sha1(b"pipeline").hexdigest()
    far = plain.prose(950, 400).split(" ")
    docs = [(i, t, "s") for i, t in good.items()]
    docs += [
        (100, good[5], "s"),  # an exact copy
        (101, " ".join([*words[:40], "changed", *words[41:]]), "t"),  # a near copy in another source
        (102, "too few words", "s"),
        (103, None, "s"),
        (104, "", None),
        (105, ("again and again the same " * 30).strip(), "s"),  # repeated windows
        (106, f"{plain.prose(960, 60)} {long_item} {plain.prose(961, 40)}", "s"),  # contaminated
        (107, " ".join([*far[:200], short_item, *far[200:]]), "s"),  # a short hit
        (108, f'{plain.prose(962, 100)} api_key = "{key}" {plain.prose(963, 20)}', "s"),
        (109, " ".join(w + "####" for w in plain.prose(964, 100).split(" ")), "s"),  # symbols in every word
    ]
    tables(spark, folder, docs, [(1, long_item), (2, short_item), (3, None)])
    out = corpus_pipeline.run(spark, folder)
    model = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    got = {r["doc_id"]: model.decode(list(r["ids"])) for r in out.collect()}
    want = {**good, 107: " ".join([*far[:200], "", *far[200:]]), 108: docs[-2][1].replace(key, "[SECRET]")}
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder, [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "benchmark_decontamination", "secret_scan", "sentence_piece_ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS and out.collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []
