import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import kneser_ney, sentence_pieces, token_files
from framewise.llm.words import ALNUM, word_runs

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.awkward(), plain.DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in plain.awkward()}


# -- words ------------------------------------------------------------------------------------------------------------


def test_words_of_runs():
    import pyarrow as pa

    rows = [r[1] for r in plain.awkward()]
    for kind, split in ((None, plain.words), (ALNUM, None)):
        for run in word_runs(pa.array(["skip", *rows])[1:], *([kind] if kind is not None else [])):
            at = 0
            for k in range(run.rows):
                n = int(run.count[k])
                got = [bytes(run.data[a:b]).decode() for a, b in zip(run.start[at : at + n], run.end[at : at + n], strict=True)]
                at += n
                assert split is None or got == split(rows[run.first + k])


# -- language model ---------------------------------------------------------------------------------------------------


def plain_model(train, order):
    grams = {order: Counter()}
    for x in train:
        y = ["<s>"] * (order - 1) + x
        grams[order].update(tuple(y[i : i + order]) for i in range(len(x)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    cut, context = {}, {}
    for n, c in grams.items():
        cut[n] = [0, *kneser_ney._discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])]
        context[n] = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            context[n][g[:-1]][0] += v
            context[n][g[:-1]][1] += cut[n][min(v, 3)]

    def probability(g, words):
        p = 1 / (words + 1)
        for n in range(1, order + 1):
            own = g[len(g) - n :]
            if own[:-1] in context[n]:
                total, left = context[n][own[:-1]]
                v = grams[n].get(own, 0)
                p = (max(v - cut[n][min(v, 3)], 0) + left * p) / total
        return p

    return probability


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_equals_plain_counting(docs, texts, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(kneser_ney, "BLOCK_WORDS", 700)
    tokens = {k: [*plain.words(t), "</s>"] for k, t in texts.items()}
    train = [t for k, t in tokens.items() if k % 4]
    model = kneser_ney.train(docs.where("doc_id % 4 <> 0"), order)
    count = Counter(w for t in train for w in t)
    assert (model.tokens, model.words) == (sum(count.values()), len(count)) and model.bits >= 2
    probability = plain_model(train, order)
    for r in kneser_ney.score_texts(docs.withColumn("score", F.lit(1)), model).collect():
        t = ["<s>"] * (order - 1) + tokens[r["doc_id"]]
        want = sum(math.log10(probability(tuple(t[i : i + order]), len(count))) for i in range(len(t) - order + 1))
        base = sum(math.log10((count[w] + 0.1) / (model.tokens + 0.1 * (len(count) + 1))) for w in tokens[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(tokens[r["doc_id"]]), sum(w in count for w in tokens[r["doc_id"]]))
        assert r["score"] == pytest.approx(want, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)


def test_probabilities_of_all_words_add_up(spark):
    words = "a b c a b a c c b a d a".split()
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    model = kneser_ney.train(df)
    every = spark.createDataFrame([(i, f"a {w}") for i, w in enumerate(["a", "b", "c", "d", "unseen"])], "doc_id long, text string")
    scorer = kneser_ney.Scorer(model)
    p = 0.0
    for _, hashes, count in (run for batch in every.select("text").toArrow().to_batches() for run in kneser_ney.token_runs(batch.column(0))):
        p += scorer.probabilities(hashes, count)[1].reshape(-1, 3)[:, 1].sum()
    ends = spark.createDataFrame([(1, "a")], "doc_id long, text string").select("text").toArrow().to_batches()[0]
    _, hashes, count = next(iter(kneser_ney.token_runs(ends.column(0))))
    assert p + scorer.probabilities(hashes, count)[1][1] == pytest.approx(1)


def test_model_of_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kneser_ney.train(empty)
    got = kneser_ney.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert [tuple(r) for r in got] == [(1, 3, 0, 0.0, 0.0)]
    assert kneser_ney.score_texts(empty, model).collect() == []


# -- SentencePiece ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def piece_models():
    from sentencepiece import sentencepiece_model_pb2

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        raw = file.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    model.trainer_spec.model_type = 1
    rng = random.Random(3)
    for p in model.pieces:
        if p.type == 1:
            p.score = -rng.uniform(5, 15)
    return {"bpe": raw, "unigram": model.SerializeToString()}


ODD = ["", " ", "  a  b ", "a▁b", "日本語 text\n\nfoo   bar", "\t\x00x 🎉🎉 é", "a" * 40 + " " + "=" * 33, "x" * 3000, " lead", "trail ", "<s> </s> <0x41> <unk>", "....!!!! ----- ÀÉ"]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_equal_the_library(piece_models, texts, kind):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=piece_models[kind])
    own = sentence_pieces.PieceModel(piece_models[kind])
    # The library adds a whole text's scores in single precision, whose rounding decides near ties of long texts.
    rows = [*ODD, *[t for t in texts.values() if t and (kind == "bpe" or len(t) < 5000)]]
    got = own.encode(rows)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == library.encode(rows)
    assert [own.decode(x) for x in got] == [t.replace("▁", " ") for t in rows]


def test_round_trip_in_spark(docs, texts, piece_models):
    encoded = sentence_pieces.encode_texts(docs.withColumn("ids", F.lit("x")), piece_models["bpe"], check=True)
    assert encoded.where("not round_trip").count() == 0
    got = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_ids(encoded, piece_models["bpe"]).collect()}
    assert got == {k: t or "" for k, t in texts.items()}
    assert sentence_pieces.encode_texts(docs.limit(0), piece_models["bpe"]).collect() == []


def test_models_that_cannot_be_matched_are_refused(piece_models):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(piece_models["bpe"])
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(model.SerializeToString())


# -- token files ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("high", [1, 2, 300, 70_000, 2**32])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (1, 4096, 4097, 9000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
        ids[rng.integers(0, n, 3)] = high - 1
        file = token_files.IdFile(b"".join(token_files.pack_file(ids, np.array([n]))))
        assert (file.ids(0, n) == ids).all() and (file.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_files_hold_the_library_ids(docs, texts, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 5000)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        raw = file.read()
    library = tokenizers.Tokenizer.from_str(raw)
    odd = ["a  b", "x \n y", "foo\nbar baz.\n\nqux", "don't we'll", "　x y", "<|endoftext|> a", "\x1f x y", "a\x85 b c"]
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(500 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    manifest = token_files.write_ids(more.withColumn("part", F.lit("x")), raw)
    got = sorted(tuple(r) for r in token_files.read_ids(manifest).collect())
    want, start = [], 0
    for k, t in sorted([*texts.items(), *[(500 + i, t) for i, t in enumerate(odd)]]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want and manifest.count() > 3
    assert token_files.read_ids(token_files.write_ids(docs.limit(0), raw)).collect() == []


ODD_SPACES = [
    None, "", " ", "  a b", "a\n b", "a \nb", "a\tb c", "a　b c", "“a” b—c 日本、語 x", "a\xa0b", "x<|endoftext|> y <|endoftext|>", "é è ñ",
    "end ", "a  b", "\n\n", "a\nb c\nd", "Ġ a Ġb", "don't can't I'll", "\x85 z", "a b", "one two one two", "\x1cq", "z" * 70_000 + " y",
    "a\n\n", "x.\n\nfoo, bar;\n(baz) 12ab ab12 it's 'tis 's' x'll,\n“q”. 日本.abc", "<|endoftext|>a", "1\n2\n", "’s don’t", "a\n\nb.c\n",
]


@pytest.mark.parametrize("store", [token_files.STORE, 5])
def test_words_encode_as_in_whole_texts(monkeypatch, store):
    monkeypatch.setattr(token_files, "STORE", store)
    monkeypatch.setattr(token_files, "LEARN", 3)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    assert encoder.cuts
    for texts in (ODD_SPACES, ODD_SPACES[::-1], [t[0] for t in ()], ["one two three", "two one"]):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_tokenizers_get_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = file.read()
    encoder = token_files.WordEncoder(spec)
    texts = ["a b", None, "don't  stop <|endoftext|> now", "é\n"]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not encoder.cuts and counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
