"""URLs that differ in the query alone are pages of their own."""

from pyspark.sql import functions as F

from framewise.llm import revisits, url_filters
from test_text_operators import RECORD

URL = "https://a.com/i?id={}"


def test_canonical_forms(spark):
    urls = [
        ("https://www.A.com/i/index.html?b=2&a=1#x", "https://a.com/i?a=1&b=2"), ("http://a.com/i?utm_source=x&b=2&&gclid", "https://a.com/i?b=2"),
        ("http://a.com/i?fbclid=1", "https://a.com/i"), ("http://a.com?q", "https://a.com?q"), ("http://a.com/?", "https://a.com"), ("a.com?b", None), (None, None),
    ]
    df = spark.createDataFrame(urls, "url string, want string").select("want", url_filters.bare_of(F.col("url")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_revisits_of_one_script(spark):
    rows = [
        (1, URL.format(1), 10, "response", {"etag": '"a"'}, "d1"), (2, URL.format(2), 20, "response", {"etag": '"b"'}, "d2"),
        (3, URL.format(1) + "&utm_medium=mail", 30, "revisit", {"etag": '"a"'}, None), (4, URL.format(2), 30, "revisit", {"etag": '"a"'}, None),
    ]
    got = {r["record_id"]: (r["response_id"], r["status"]) for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {3: (1, "resolved"), 4: (2, "mismatch")}


def test_a_link_blocks_its_own_page_alone(spark):
    rules = spark.createDataFrame([("evil.org", "/", "block")], "host string, path string, verdict string")
    pages = [(1, URL.format(1), '<link rel="canonical" href="https://evil.org/a">'), (2, URL.format(2), ""), (3, "http://www.a.com/i.html?id=1&utm_id=7", "")]
    got = url_filters.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow", 3: "block"}


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([("evil.org", "/", "block")], "host string, path string, verdict string")
    host = "a." * 20_000
    pages = [(1, f"https://{host}evil.org/x", None), (2, f"https://{host}org", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge_pages(df, rules).collect()} == {1: "block", 2: "allow"}
    assert {r["verdict"] for r in url_filters.judge_pages(df, rules.limit(0)).collect()} == {"allow"}
