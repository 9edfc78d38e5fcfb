import hashlib
import re

import plain
import pytest
from pyspark.sql import functions as F

from framewise.llm import components, decontamination, licenses, outliers, parity_join, revisits, secrets, storage, url_filters


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.awkward(), plain.DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in plain.awkward()}


def clash(df, *names):
    """Extra columns with the names that the operators use themselves."""
    return df.withColumns({n: F.lit(n) for n in names})


# -- components -------------------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(5, 5), (None, 3), (7, 8)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), storage.shared_folder(spark))
    want = {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(7, 30)}}
    assert {r[0]: r[1] for r in found.collect()} == want


def test_components_of_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), storage.shared_folder(spark)).count() == 0


# -- Jaccard join -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 8, 10)])
def test_join_equals_all_pairs(docs, texts, size, num, den):
    got = parity_join.jaccard_components(clash(docs, "n_shingles", "component", "keys"), size, num, den).collect()
    want = plain.components(texts, size, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {k: (len(plain.shingles(t, size)), want[k]) for k, t in texts.items()}


def test_join_finds_chains_in_large_groups(spark):
    base = plain.prose(5, 160).split(" ")
    rows = []
    for k in range(150):
        w = list(base)
        for j in range(k % 40):
            w[(7 * j + k) % 160] = f"new{k}x{j}"
        rows.append((k, " ".join(w)))
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain.components(dict(rows), 4, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_join_keeps_rows_without_id_and_repeats(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = parity_join.jaccard_components(df)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert sorted((r[0] for r in parity_join.first_of_each(df, got).collect()), key=str) == [1, None]


def test_join_of_no_rows(spark):
    assert parity_join.jaccard_components(spark.createDataFrame([], plain.DOCS)).collect() == []


def test_sketch_parts_of_band_neighbours():
    bands = parity_join.Bands(85, 100)
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            own = set(bands.of(a)) & set(bands.of(b))
            assert any(bands.most[k] >= bands.differences(a + b) for k in own)


# -- quality ----------------------------------------------------------------------------------------------------------


def test_statistics_equal_plain_counts(docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = outliers.text_statistics(docs).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == {k: plain.statistics(t) for k, t in texts.items()}


def test_outliers_go_and_others_stay(spark):
    rows = [(i, plain.prose(i, 60 + i % 50), "en", "s" if i % 3 else "t") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in plain.prose(i, 80).split(" ")), "en", "s") for i in range(5)]
    rows += [(2000, "too few words", "en", "s"), (2001, None, None, None), (2002, plain.prose(3, 70), None, None)]
    out = outliers.quality_verdicts(clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "d2", "kept", "n_words"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert [k for k, v in kept.items() if not v and k < 1000] == []
    assert not any(kept[k] for k in (1000, 1001, 1002, 1003, 1004, 2000, 2001)) and kept[2002]


def test_outliers_do_not_depend_on_the_layout(spark):
    rows = [(i, plain.prose(i % 150, 30 + i % 40) + "#" * (i % 5), "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, two = ({r["doc_id"]: r["d2"] for r in outliers.quality_verdicts(df.repartition(n)).collect()} for n in (1, 5))
    assert one == two


def test_quality_of_no_rows(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert outliers.quality_verdicts(empty).collect() == []
    assert outliers.kept_documents(empty, outliers.quality_verdicts(empty)).columns == empty.columns


# -- decontamination --------------------------------------------------------------------------------------------------

ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(text, items, size):
    word = lambda t: ASCII_WORD.findall((t or "").translate(plain.LOWER))
    windows = {}
    for name, item in items:
        w = word(item)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    w, hit, found = word(text), set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if names := windows.get(tuple(w[i : i + n])):
                hit.update(range(i, i + n))
                found |= names
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard", [decontamination.SHARD_BYTES, 300])
def test_leaks_equal_window_search(spark, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
    items = [(1, plain.prose(1, 30)), (2, plain.prose(2, 13)), (3, "te ta to"), (4, "te"), (5, None), (6, " !? "), (7, plain.prose(1, 30)), (8, "ta to ta to ta to te")]
    both = plain.prose(1, 30).split(" ")
    rows = [(1, plain.prose(3, 200) + " " + " ".join(both[4:25]) + " zz"), (2, "Te-TA, to"), (3, None), (4, ""), (5, " ".join(both[:12])), (6, "ta to ta to ta to ta to te te ta")]
    rows += [(7, plain.prose(2, 13) + "é " + plain.prose(2, 13)), (7, plain.prose(2, 13)), (None, "te")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.leak_report(clash(df, "row", "spans", "items"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(k, *leaks(t, [i for i in items if i[1]], 13)) for k, t in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == sorted(want, key=str)


def test_leaks_are_cut_or_documents_dropped(spark):
    item = plain.prose(1, 20)
    df = spark.createDataFrame([(1, plain.prose(9, 600) + "\n" + item + " end", "x"), (2, item, "x"), (3, None, "x")], "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in decontamination.remove_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3} and got[1]["text"] == plain.prose(9, 600) + "\n end" and got[3]["text"] is None and got[1]["row"] == "x"


def test_no_items_and_no_documents(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.leak_report(df, items).select("n_words", "n_hit", "contaminated").collect() == [(2, 0, False)]
    assert decontamination.leak_report(df.limit(0), items).collect() == []


# -- secrets ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def found(spark, docs):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(900, f'say token = "{key}" and card 4521940886194967 here. commit {key} '), (901, f"{key}"), (902, None), (903, ""), (900, None)]
    rows += [(904, "x" * 50_000 + " nothing" + "1" * 30_000)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    return every, secrets.scan(clash(every, "place", "candidate", "score", "path"), path="path").cache(), key


def test_secret_is_found_and_harmless_strings_are_not(found):
    _, judged, key = found
    got = [(r["doc_id"], r["candidate"], r["secret"]) for r in judged.where("doc_id = 900").orderBy("position").collect()]
    assert got == [(900, key, True), (900, "4521940886194967", False), (900, key, False)]


def test_positions_and_masks(found):
    every, judged, key = found
    wrong = judged.alias("f").join(every.alias("d"), ["doc_id"]).where(F.col("d.text").isNotNull() & (F.col("doc_id") != 900))
    assert wrong.where(F.expr("substring(d.text, position + 1, length(candidate)) <> candidate")).count() == 0
    masked = secrets.mask_secrets(every, judged)
    assert masked.count() == every.count() and masked.columns == every.columns
    text = masked.where("doc_id = 900 and text is not null").first()["text"]
    assert text == f'say token = "{secrets.MASK}" and card 4521940886194967 here. commit {key} '


def test_forest_on_held_out_findings(spark):
    rows = [(i, plain.prose(i, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dictionary = secrets.corpus_dictionary(df)
    planted = secrets.planted_findings(df)
    features = secrets.finding_features(planted, ["key", "secret"], dictionary, secrets.pair_scores(dictionary)).cache()
    fold = F.pmod(F.xxhash64(F.substring_index("key", ":", 1), F.lit(3)), F.lit(4))
    model = secrets.train_forest(features.where(fold != 0))
    right = model.transform(features.where(fold == 0)).select((F.col("_prediction") == F.col("secret").cast("double")).cast("double").alias("r"))
    assert right.count() > 300 and right.agg(F.avg("r")).first()[0] > 0.97


def test_scan_of_no_rows(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert secrets.scan(empty).collect() == []
    assert secrets.mask_secrets(empty, secrets.scan(empty)).columns == empty.columns


# -- URL filters ------------------------------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("bad.com", "/x/", "block"), ("evil.org", "/", "block"), ("good.net", "/", "allow")]


def test_rules_aliases_and_precedence(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    link = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    pages = [
        (1, "http://WWW.Bad.com/x/1?q#f", ""),
        (2, "https://bad.com/y", None),
        (3, "https://mirror.org/a", link("https://evil.org/a")),
        (4, "https://mirror.org/b", '<meta http-equiv="refresh" content="0; url=//evil.org/b">'),
        (5, "https://mirror.org/b.html#z", link("https://good.net/b")),
        (6, "https://other.org/c", link("/d")),
        (7, None, None),
        (8, "no scheme", ""),
        (9, "https://bad.com", ""),
        (9, "https://bad.com", ""),
    ]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string"), "node", "component", "verdict")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["basis"]) for r in url_filters.judge_pages(df, rules).na.fill("-").collect())
    assert got == [
        (1, "www.bad.com", "/x/1", "bad.com/x/", "block", "rule"),
        (2, "bad.com", "/y", "com/", "allow", "rule"),
        (3, "mirror.org", "/a", "-", "block", "alias"),
        (4, "mirror.org", "/b", "-", "allow", "alias"),
        (5, "mirror.org", "/b.html", "-", "allow", "alias"),
        (6, "other.org", "/c", "-", "allow", "default"),
        (7, "", "", "-", "allow", "default"),
        (8, "", "", "-", "allow", "default"),
        (9, "bad.com", "", "-", "allow", "default"),
        (9, "bad.com", "", "-", "allow", "default"),
    ]


def test_no_pages_or_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c", None)], "page_id long, url string, html string")
    assert url_filters.judge_pages(pages, rules).select("verdict", "basis").collect() == [("allow", "default")]
    assert url_filters.judge_pages(pages.limit(0), rules).collect() == []


# -- revisits ---------------------------------------------------------------------------------------------------------

RECORD = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string"


def test_revisits(spark):
    u = "http://www.a.com/p.html"
    rows = [
        (1, u, 100, "response", {"ETag": '"x"', "Content-Length": "9", "Set-A": "1"}, "d1"),
        (2, u, 100, "response", {"ETag": '"y"'}, "d2"),
        (3, "https://a.com/p#f", 101, "revisit", {"etag": 'W/"y"', "content-length": "0", "Date": "now", "DATE": "then"}, None),
        (4, u, 100, "revisit", {"etag": '"y"'}, None),
        (5, u, 90_000, "revisit", {"etag": '"x"'}, None),
        (6, u, 90_001, "response", {"Last-Modified": "m"}, "d6"),
        (7, u, 900_000, "revisit", {"last-modified": "m", "X": "1"}, None),
        (8, u, 900_001, "revisit", None, "d6"),
        (9, u, 900_002, "revisit", None, None),
        (10, None, 5, "revisit", None, None),
        (11, u, None, "revisit", None, None),
        (8, u, 900_001, "revisit", None, "d6"),
    ]
    df = clash(spark.createDataFrame(rows, RECORD), "key", "status", "response_id", "bucket")
    got = sorted(((r["record_id"], r["response_id"], r["status"], r["headers"], r["digest"]) for r in revisits.resolve_revisits(df).collect()), key=lambda r: r[0])
    assert got == [
        (3, 2, "resolved", {"etag": '"y"', "date": "then, now"}, "d2"),
        (4, None, "no_response", None, None),
        (5, 2, "mismatch", None, None),
        (7, 6, "resolved", {"last-modified": "m", "x": "1"}, "d6"),
        (8, 6, "resolved", {"last-modified": "m"}, "d6"),
        (8, 6, "resolved", {"last-modified": "m"}, "d6"),
        (9, 6, "mismatch", None, None),
        (10, None, "no_response", None, None),
        (11, None, "no_response", None, None),
    ]


def test_no_records(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORD)).collect() == []


# -- licences ---------------------------------------------------------------------------------------------------------


def wrap(text, width=60):
    lines, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            lines, line = [*lines, line], ""
        line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def test_licences(spark):
    s = licenses.SENTENCES
    mit = "\n\n".join(wrap(s[k]) for k in ("mit-grant", "mit-notice", "mit-as-is"))
    bsd = " ".join(s[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"))
    rows = [
        (1, "Copyright (c) X\n\n" + mit),
        (2, bsd),
        (3, "no stop before\nReleased under the MIT License.\nafter. released  under the MIT license!"),
        (4, wrap(s["mit-notice"])),
        (5, None),
        (6, ""),
        (7, "word " * 50_000 + ". Licensed under CC BY-NC 4.0.\n" + s["apache-short"]),
        (7, s["apache-short"]),
    ]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "found", "licence", "way")
    got = sorted(tuple(r) for r in licenses.scan_licenses(df).collect())
    assert got == [(1, "MIT", 1, 3), (2, "BSD-3-Clause", 1, 4), (3, "MIT", 2, 1), (7, "Apache-2.0", 1, 1), (7, "Apache-2.0", 1, 1), (7, "CC-BY-NC-4.0", 1, 1)]
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_rules_need_known_sentences():
    with pytest.raises(ValueError):
        licenses.check_rules(licenses.SENTENCES, [("X", ["gpl-free"])])
