"""Quality rules on groups with much junk, and on lines with blanks at their ends."""

import plain

from framewise.llm import outliers

SCHEMA = "doc_id long, text string, lang string, source string"


def test_a_third_of_junk_goes(spark):
    rows = [(i, plain.prose(i, 60 + i % 50), "en", "s") for i in range(200)]
    wide = lambda w: (w + "abcdefghijklmno")[:15]
    rows += [(1000 + i, " ".join(map(wide, plain.prose(500 + i, 60 + i % 50).split(" "))), "en", "s") for i in range(100)]
    out = outliers.quality_verdicts(spark.createDataFrame(rows, SCHEMA))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i in range(200))
    assert not any(kept[1000 + i] for i in range(100))


def test_cutoff_is_its_tail():
    assert abs(outliers._chi_square(len(outliers.FEATURES), outliers.CUTOFF) - (1 - 1e-6)) < 1e-8


def test_lines_keep_their_ends(spark):
    texts = ["a b\r\na b\r\n", " foo\nfoo", "\tx\nx\n\tx", "a \nb\na ", "a b\r\na b", "  \n a\n a\n  ", "\x0bq\nq\x0c\n\x0bq"]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], SCHEMA)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in outliers.text_statistics(df).collect()}
    assert got == {k: plain.statistics(t) for k, t in enumerate(texts)}
    assert (got[0][3], got[1][3]) == (1, 0)
