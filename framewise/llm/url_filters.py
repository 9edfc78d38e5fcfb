"""URL filters with redirect equivalence.

Rules (host and path, allow or block) fit a URL whose host is the rule's or one of its subdomains and whose path begins
with the rule's; the longest rule wins. URLs without a rule of their own take the decision of their aliases: URLs are
nodes, redirects and canonical links are edges, and connected components carry decisions over. An allowed alias comes
before blocked ones; without a decided alias the verdict is the default.

Edges are read from pages (``<link rel=canonical>`` and ``<meta http-equiv=refresh>``) and made from the URL itself: a
page's canonical form without fragment and file ending and with the query's parameters sorted, tracking ones dropped, and the redirect of ``www.`` and ``m.`` hosts to the
bare host over https.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, has no aliases and gets the
default; of rules of one length the one with the longer host wins, then allow; repeated pages get equal rows; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.components import connected_components
from framewise.llm.storage import shared_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"
ENDING = r"(/index)?(\.html?|/)?$"
BARE = r"^(www|m)\."
#: Parameters that say where a visitor came from, not what the page is.
TRACKING = r"^(utm_[^=]*|gclid|dclid|fbclid|msclkid|yclid|igshid|mc_cid|mc_eid|_ga)(=|$)"
LINKS = (
    (r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"),
)
DEFAULT = "allow"
ALLOW, BLOCK = "allow", "block"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, group)


def host_of(url: Column) -> Column:
    return F.translate(part(url, 2), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return part(url, 3)


def query_of(url: Column) -> Column:
    """The query with sorted parameters and without tracking ones, with its ``?``; empty where nothing is left."""
    given = F.split(F.regexp_replace(part(url, 4), r"^\?", ""), "&")
    kept = F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, no fragment; null where there is no ``://``."""
    text = F.concat(F.translate(part(url, 1), UPPER, LOWER), F.lit("://"), host_of(url), path_of(url), part(url, 4))
    return F.when(url.contains("://"), text)


def canonical_of(url: Column) -> Column:
    """The page's canonical form on its own host."""
    text = F.concat(F.translate(part(url, 1), UPPER, LOWER), F.lit("://"), host_of(url), F.regexp_replace(path_of(url), ENDING, ""), query_of(url))
    return F.when(url.contains("://"), text)


def bare_of(url: Column) -> Column:
    """The canonical form on the bare host over https."""
    text = F.concat(F.lit("https://"), F.regexp_replace(host_of(url), BARE, ""), F.regexp_replace(path_of(url), ENDING, ""), query_of(url))
    return F.when(url.contains("://"), text)


def _resolved(base: Column, link: Column) -> Column:
    """A link seen from a page."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that redirects or canonical links join."""
    url = F.col("url")
    own = pages.select(F.explode(F.array(F.struct(node_of(url).alias("a"), canonical_of(url).alias("b")), F.struct(canonical_of(url).alias("a"), bare_of(url).alias("b")))).alias("e"))
    edges = own.select("e.*")
    linked = pages.where(F.col("html").rlike("(?i)canonical|refresh") & url.contains("://"))
    for tag, attribute in LINKS:
        link = F.regexp_extract(F.regexp_extract("html", tag, 0), attribute, 1)
        found = linked.withColumn("_link", link).where(F.col("_link") != "")
        edges = edges.union(found.select(node_of(url), node_of(_resolved(url, F.col("_link")))))
    return edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) that a rule fits. Each host is looked up by its suffixes of
    at most as many labels as the longest rule's host."""
    labels = F.split("host", r"\.")
    most = rules.agg(F.coalesce(F.max(F.size(labels)), F.lit(0)).alias("most"))
    first = F.greatest(F.lit(1), F.size(labels) - F.col("most") + 1)
    suffix = F.explode(F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    seen = urls.where(F.col("host") != "").select("host", "path").distinct()
    seen = seen.crossJoin(F.broadcast(most)).where("most > 0").select("host", "path", suffix.alias("suffix"))
    given = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "verdict")
    fits = seen.join(given, "suffix").where(F.expr("startswith(path, rule_path)"))
    rule = F.concat("suffix", "rule_path")
    order = F.struct(F.length(rule), F.length("suffix"), F.col("verdict") == ALLOW)
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), order).alias("r"))
    return best.select("host", "path", "r.*")


def judge_pages(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, basis (rule, alias or default).

    ``rules`` has host, path and verdict; ``edges`` are further pairs of URLs (a, b) that are known aliases, as from a
    crawl's redirects.
    """
    folder = shared_folder(pages.sparkSession)
    joined = page_edges(pages)
    if edges is not None:
        joined = joined.union(edges.select(node_of(F.col("a")), node_of(F.col("b")))).dropna()
    parts = connected_components(joined, folder)
    named = parts.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    verdicts = stored(rule_verdicts(named.select("host", "path").union(_parsed(pages).select("host", "path")), rules), folder)
    decided = named.join(verdicts, ["host", "path"]).groupBy("component").agg(
        F.when(F.max(F.col("verdict") == ALLOW), F.lit(ALLOW)).otherwise(F.lit(BLOCK)).alias("alias_verdict")
    )
    by_node = parts.join(decided, "component").select("node", "alias_verdict")
    rows = _parsed(pages).join(verdicts, ["host", "path"], "left").join(by_node, "node", "left")
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", "alias_verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("basis"),
    )


def _parsed(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
