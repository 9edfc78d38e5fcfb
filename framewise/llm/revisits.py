"""Not-modified revisits of a web archive, resolved to the response that they confirm.

A revisit takes the latest earlier full response of its canonical URL (an as-of join; the URL keeps its query, with sorted
parameters and without tracking ones), if the validators agree, and
that response's headers with the permitted ones of the revisit put in.

The as-of join works on distinct (URL, time) points: responses of one point are grouped first, a window orders the
points of one URL and hour, and each hour's last response is carried to the URL's later hours over one row per hour.
So a URL with any share of the records never lies in one task: its rows meet only as points of an hour, of which a clock
in seconds has 3,600, and as hours.

Defined cases: a revisit without URL, time or earlier response is ``no_response``; of responses at one time the
largest record_id counts; a response at the revisit's own time is not earlier; header names are compared in lower case,
and repeated names join their values with ``, `` in the order of the names as written; null headers are no headers; repeated records resolve
alike. Columns other than the six of a record are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.url_filters import bare_of

BUCKET = 3600
#: Headers of a 304 that describe its own message or connection, never the stored response.
FORBIDDEN = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
    "etag", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def plain_headers(headers: Column) -> Column:
    """Headers with lower-case names; values of one name joined."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = F.transform(
        names, lambda n: F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", ")
    )
    return F.map_from_arrays(names, values)


def earlier_responses(records: DataFrame) -> DataFrame:
    """(key, ts, response_id): for each distinct (key, ts) of a revisit the latest response before it, if any."""
    known = records.where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    own = F.when(F.col("kind") == "response", F.col("record_id"))
    points = known.groupBy("key", "ts").agg(F.max(own).alias("id"), F.max(F.col("kind") == "revisit").alias("asked"))
    points = points.withColumn("bucket", F.floor(F.col("ts") / BUCKET))
    within = Window.partitionBy("key", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = points.withColumn("near", F.last("id", ignorenulls=True).over(within))
    hours = points.where(F.col("id").isNotNull()).groupBy("key", "bucket").agg(F.max_by("id", "ts").alias("id"))
    asked = near.where("asked").select("key", "bucket").distinct()
    line = hours.join(asked, ["key", "bucket"], "full")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.select("key", "bucket", F.last("id", ignorenulls=True).over(before).alias("far"))
    joined = near.where("asked").join(carried, ["key", "bucket"], "left")
    return joined.select("key", "ts", F.coalesce("near", "far").alias("response_id"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, key, ts, response_id, status, headers, digest.

    Records have record_id, url, ts (seconds), kind (response or revisit), headers (map) and digest. ``status`` is
    resolved, mismatch (validators or digests differ) or no_response; headers and digest are null unless resolved.
    ETags are compared weakly; without one on both sides Last-Modified decides, then the digest; a revisit with neither
    validator nor digest confirms only a response without validators.
    """
    rows = records.select("record_id", bare_of(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", plain_headers(F.col("headers")).alias("headers"), "digest")
    found = earlier_responses(rows)
    revisits = rows.where("kind = 'revisit'").join(found, ["key", "ts"], "left")
    stored = rows.where("kind = 'response'").groupBy("record_id").agg(F.max_by(F.struct("headers", "digest"), "ts").alias("r"))
    stored = stored.select(F.col("record_id").alias("response_id"), F.col("r.headers").alias("kept"), F.col("r.digest").alias("kept_digest"))
    pairs = revisits.join(stored, "response_id", "left")
    status = F.when(F.col("response_id").isNull(), "no_response").when(_agrees(), "resolved").otherwise("mismatch")
    merged = F.map_concat(
        F.map_filter("kept", lambda k, _: ~F.coalesce(F.map_contains_key(_permitted(F.col("headers")), k), F.lit(False))),
        _permitted(F.col("headers")),
    )
    out = pairs.withColumn("status", status)
    fine = F.col("status") == "resolved"
    return out.select(
        "record_id", "key", "ts", "response_id", "status",
        F.when(fine, merged).alias("headers"), F.when(fine, F.col("kept_digest")).alias("digest"),
    )


def _permitted(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~k.isin(*FORBIDDEN))


def _agrees() -> Column:
    tag = lambda h: F.regexp_replace(F.get(F.transform(F.array(h), lambda x: F.try_element_at(x, F.lit("etag"))), F.lit(0)), "^W/", "")
    changed = lambda h: F.try_element_at(h, F.lit("last-modified"))
    new, old = F.col("headers"), F.col("kept")
    bare = tag(old).isNull() & changed(old).isNull()
    same = (
        F.when(tag(new).isNotNull() & tag(old).isNotNull(), tag(new) == tag(old))
        .when(changed(new).isNotNull() & changed(old).isNotNull(), changed(new) == changed(old))
        .when(F.col("digest").isNotNull() & F.col("kept_digest").isNotNull(), F.col("digest") == F.col("kept_digest"))
        .otherwise(bare & tag(new).isNull() & changed(new).isNull())
    )
    return F.coalesce(same, F.lit(False))


def records_from_pages(pages: DataFrame) -> DataFrame:
    """A crawl's records derived from pages: of each page a response, two revisits and, for every third page, a later
    response with other content. Validators follow the page's content; some revisits carry a stale or no validator."""
    page, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    start = F.lit(1_700_000_000) + (page * 7919) % 7_776_000
    changed = lambda t: F.concat(F.lit("t"), t.cast("string"))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    record = lambda k, t, kind, headers, d: F.struct(
        (page * 4 + k).alias("record_id"), t.cast("long").alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"), d.alias("digest")
    )
    text = lambda c: c.cast("string")
    full = lambda t, e: F.create_map(
        F.lit("ETag"), e, F.lit("Last-Modified"), changed(t), F.lit("Content-Length"), text(F.length(F.coalesce("html", F.lit("")))), F.lit("Cache-Control"), F.lit("max-age=60")
    )
    when = lambda k: start + k * 86_400 + page % 97
    stale = F.when((page + 1) % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    one = F.create_map(F.lit("etag"), stale, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600"))
    two = F.create_map(F.lit("Last-Modified"), changed(F.when(page % 3 == 0, when(2)).otherwise(start)), F.lit("Age"), F.lit("7"))
    every = F.array(
        record(0, start, "response", full(start, tag), digest),
        record(1, when(1), "revisit", one, F.lit(None).cast("string")),
        record(2, when(3), "revisit", two, F.lit(None).cast("string")),
    )
    again = record(3, when(2), "response", full(when(2), F.concat(F.lit('"2'), digest, F.lit('"'))), F.md5(F.concat(digest, F.lit("2"))))
    records = F.when(page % 3 == 0, F.concat(every, F.array(again))).otherwise(every)
    return pages.select("url", F.explode(records).alias("r")).select("r.record_id", "url", "r.ts", "r.kind", "r.headers", "r.digest")
