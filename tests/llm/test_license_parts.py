"""Known sentences that the cutter takes apart."""

import pytest

from framewise.llm import licenses


@pytest.mark.parametrize("end", ["\n", " "])
def test_every_rule_matches_its_own_sentences(spark, end):
    rows = [(k, end.join(licenses.SENTENCES[i] for i in ids)) for k, (_, ids) in enumerate(licenses.RULES)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(k, name, 1, len(ids)) for k, (name, ids) in enumerate(licenses.RULES)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("mark", ["//", "#", " *", ";", "--"])
def test_every_rule_matches_in_comments(spark, mark):
    def block(ids):
        lines = [f"{mark} Copyright 2020 Foo", mark]
        for i in ids:
            words = licenses.SENTENCES[i].split(" ")
            lines += [f"{mark} " + " ".join(words[k : k + 8]) for k in range(0, len(words), 8)] + [mark]
        return "\n".join(lines)

    rows = [(k, block(ids)) for k, (_, ids) in enumerate(licenses.RULES)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(k, name, 1, len(ids)) for k, (name, ids) in enumerate(licenses.RULES)]
