"""Registered queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import (
    bayes_minhash,
    decontamination,
    kneser_ney,
    licenses,
    mean_ordered_kmeans,
    merkle_manifest,
    outliers,
    parity_join,
    revisits,
    secrets,
    sentence_pieces,
    token_files,
    url_filters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _query_sql(query: str) -> str:
    """A URL's query in SQL, its parameters sorted and tracking ones dropped."""
    kept = f"list_filter(string_split(regexp_replace({query}, '^\\?', ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{url_filters.TRACKING}'))"
    return f"(CASE WHEN len({kept}) > 0 THEN '?' || array_to_string(list_sort({kept}), '&') ELSE '' END)"


_URL = "'(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)'"
_REVISIT_SQL = """
WITH p AS (SELECT page_id, url, html, 1700000000 + (page_id * 7919) % 7776000 AS t, md5(coalesce(html, '')) AS d, length(coalesce(html, '')) AS n,
    CASE WHEN contains(url, '://') THEN 'https://' || regexp_replace(lower(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)', 2)), '^(www|m)\\.', '')
      || regexp_replace(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)', 3), '(/index)?(\\.html?|/)?$', '') || {query} END AS key FROM pages),
r AS (
  SELECT page_id * 4 AS id, key, t AS ts, '"' || d || '"' AS tag, 't' || t AS lm, n, d FROM p
  UNION ALL SELECT page_id * 4 + 3, key, t + 172800 + page_id % 97, '"2' || d || '"', 't' || (t + 172800 + page_id % 97), n, md5(d || '2') FROM p WHERE page_id % 3 = 0),
v AS (
  SELECT page_id * 4 + 1 AS id, key, t + 86400 + page_id % 97 AS ts, CASE WHEN (page_id + 1) % 5 = 0 THEN '"stale"' ELSE '"' || d || '"' END AS tag, NULL AS lm, 'max-age=600' AS cc, NULL AS age FROM p
  UNION ALL SELECT page_id * 4 + 2, key, t + 259200 + page_id % 97, NULL, 't' || CASE WHEN page_id % 3 = 0 THEN t + 172800 + page_id % 97 ELSE t END, NULL, '7' FROM p),
j AS (SELECT v.*, r.id AS rid, r.tag AS rtag, r.lm AS rlm, r.n AS rn, r.d AS rd,
    row_number() OVER (PARTITION BY v.id ORDER BY r.ts DESC, r.id DESC) AS k FROM v LEFT JOIN r ON r.key = v.key AND r.ts < v.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN tag = rtag OR lm = rlm THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE k = 1)
SELECT id AS record_id, key, ts, rid AS response_id, status,
  CASE WHEN status = 'resolved' THEN rtag END AS etag, CASE WHEN status = 'resolved' THEN coalesce(lm, rlm) END AS last_modified,
  CASE WHEN status = 'resolved' THEN rn::VARCHAR END AS content_length, CASE WHEN status = 'resolved' THEN coalesce(cc, 'max-age=60') END AS cache_control,
  CASE WHEN status = 'resolved' THEN age END AS age, CASE WHEN status = 'resolved' THEN rd END AS digest
FROM s
""".replace("{query}", _query_sql(f"regexp_extract(url, {_URL}, 4)"))


@query("op1_revisits", _REVISIT_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every revisit of the crawl records derived from pages, resolved."""
    out = revisits.resolve_revisits(revisits.records_from_pages(table(spark, folder, "pages")))
    header = lambda name: F.try_element_at("headers", F.lit(name)).alias(name.replace("-", "_"))
    headers = [header(n) for n in ("etag", "last-modified", "content-length", "cache-control", "age")]
    return out.select("record_id", "key", "ts", "response_id", "status", *headers, "digest")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _url_sql() -> str:
    parts = _URL
    part = lambda url, k: f"regexp_extract(coalesce({url}, ''), {parts}, {k})"
    node = lambda u: f"lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || {part(u, 3)} || {part(u, 4)}"
    cut = "regexp_replace({}, '(/index)?(\\.html?|/)?$', '')".format
    link = lambda tag, attribute: f"regexp_extract(regexp_extract(html, '{tag}'), '{attribute}', 1)"
    quote = "[\"'']?"
    links = (
        link(rf"(?is)<link\b[^>]*?\brel\s*=\s*{quote}canonical\b[^>]*>", rf"(?is)\bhref\s*=\s*{quote}([^\"''\s>]+)"),
        link(rf"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*{quote}refresh\b[^>]*>", rf"(?is)\burl\s*=\s*{quote}([^\"''\s>]+)"),
    )
    root = f"{part('url', 1)} || '://' || {part('url', 2)}"
    resolved = f"""CASE WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN {part('url', 1)} || ':' || l WHEN starts_with(l, '/') THEN {root} || l
      ELSE {root} || coalesce(nullif(regexp_replace({part('url', 3)}, '[^/]*$', ''), ''), '/') || l END"""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
p AS (SELECT page_id, url, html, lower({part('url', 2)}) AS host, {part('url', 3)} AS path, CASE WHEN contains(url, '://') THEN {node('url')} END AS node,
    CASE WHEN contains(url, '://') THEN lower({part('url', 1)}) || '://' || lower({part('url', 2)}) || {cut(part('url', 3))} || {_query_sql(part('url', 4))} END AS canon,
    CASE WHEN contains(url, '://') THEN 'https://' || regexp_replace(lower({part('url', 2)}), '^(www|m)\\.', '') || {cut(part('url', 3))} || {_query_sql(part('url', 4))} END AS bare FROM pages),
l AS (SELECT url, node, {links[0]} AS l FROM p UNION ALL SELECT url, node, {links[1]} FROM p),
e(a, b) AS (SELECT node, canon FROM p UNION SELECT canon, bare FROM p UNION SELECT node, {node("r")} FROM (SELECT node, {resolved} AS r FROM l WHERE l <> '') WHERE contains(r, '://')),
sides(a, b) AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
parts AS (SELECT a AS node, min(b) AS component, lower({part('a', 2)}) AS host, {part('a', 3)} AS path FROM reach GROUP BY a),
verdicts AS (SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict = 'allow' DESC) AS k
  FROM (SELECT host, path FROM parts UNION SELECT host, path FROM p) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
own AS (SELECT * FROM verdicts WHERE k = 1),
decided AS (SELECT component, CASE WHEN bool_or(rule_verdict = 'allow') THEN 'allow' ELSE 'block' END AS alias FROM parts JOIN own USING (host, path) GROUP BY component)
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, alias, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN alias IS NOT NULL THEN 'alias' ELSE 'default' END AS basis
FROM p LEFT JOIN own ON p.host = own.host AND p.path = own.path LEFT JOIN parts ON p.node = parts.node LEFT JOIN decided ON parts.component = decided.component
"""


@query("op2_url_filters", _url_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_pages(table(spark, folder, "pages"), rules)


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    known = ", ".join(f"({quote(k)}, {norm(quote(v))})" for k, v in licenses.SENTENCES.items())
    rules = ", ".join(f"({k}, {quote(n)}, [{', '.join(map(quote, ids))}])" for k, (n, ids) in enumerate(licenses.RULES))
    # RE2 has no look-behind: a mark is put after each stop first.
    cut = lambda stop: f"string_split_regex(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(30), 'g'), {stop})"
    return f"""
WITH known(id, sentence) AS (VALUES {known}), rules(rule, licence, ids) AS (VALUES {rules}),
hinted AS (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|warrant|permission|redistribut|public domain')),
ways AS (SELECT doc_id, text, 0 AS way, {cut("chr(30) || '|\n'")} AS parts FROM hinted
  UNION ALL SELECT doc_id, text, 1, {cut("chr(30) || '|\n[ \\t\\r]*\n\\s*'")} FROM hinted),
each_part AS (SELECT doc_id, text, way, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM ways),
found AS (SELECT doc_id, text, way, list(id ORDER BY place, id) AS found FROM (SELECT *, {norm("part")} AS sentence FROM each_part) JOIN known USING (sentence) GROUP BY ALL),
heads AS (SELECT *, unnest(generate_series(1, len(found))) AS pos FROM found),
hits AS (SELECT doc_id, text, way, pos, licence, len(ids) AS n, row_number() OVER (PARTITION BY doc_id, text, way, pos ORDER BY len(ids) DESC, rule) AS k
  FROM heads JOIN rules ON found[pos:pos + len(ids) - 1] = ids),
per_way AS (SELECT doc_id, text, way, licence, count(*) AS m, max(n) AS n FROM hits WHERE k = 1 GROUP BY ALL)
SELECT doc_id, licence, max(m) AS n_matches, max(n) AS n_sentences FROM per_way GROUP BY doc_id, text, licence
"""


@query("op7_license_scan", _license_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document."""
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op5_jaccard_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the documents under Jaccard similarity of four-word shingles of 0.85 or more."""
    return parity_join.jaccard_components(table(spark, folder, "documents"))


@query("op10_quality_outliers")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics, base rule and robust-distance verdict of every document."""
    out = outliers.quality_verdicts(table(spark, folder, "documents"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*names, F.round("d2", 3).alias("distance"))


@query("op3_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    out = decontamination.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op6_secret_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate in the documents with the forest's score and verdict; the string itself as a digest."""
    found = secrets.scan(table(spark, folder, "documents"), path="source")
    digest = F.sha2("candidate", 256).alias("candidate_sha256")
    size = F.length("candidate").cast("long").alias("length")
    return found.select("doc_id", "position", size, digest, F.round("score", 4).alias("score"), "secret")


@query("op9_sentence_pieces")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and whether decoding gives the text back."""
    out = sentence_pieces.encode_texts(table(spark, folder, "documents"), piece_model(), check=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def piece_model(path: str | None = None) -> bytes:
    """Content of a SentencePiece model file, by default the public one of this machine."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query("op4_language_model")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document under a model of those whose checksum isn't divisible by ten."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    model = kneser_ney.train(docs.where(~held_out))
    out = kneser_ney.score_texts(docs, model)
    return out.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to patched frame-of-reference files and read back."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return token_files.read_ids(token_files.write_ids(table(spark, folder, "documents"), tokenizer))


@query("op11_bayes_minhash")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the documents under Jaccard similarity of two-word shingles of 0.8 or more."""
    return bayes_minhash.near_duplicates(table(spark, folder, "documents"))


def _kmeans_sql(clusters: int = 8, rounds: int = 10, size: int = 64) -> str:
    def assigned(k: int) -> str:
        # Both lists are walked by place; the sums are exact integers.
        gap = f"list_sum(list_transform(generate_series(1, {size}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
        near = f"SELECT row_id, vec_id, v, number, {gap} AS distance FROM v CROSS JOIN c{k}"
        return f"SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, number) = 1"

    steps = []
    for k in range(rounds):
        sums = "SELECT number, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a, generate_series(1, {}) t(i) GROUP BY number, i".format(size)
        floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
        moved = f"SELECT number, list({floor} ORDER BY i) AS c FROM m GROUP BY number"
        steps.append(
            f"c{k + 1} AS MATERIALIZED (WITH a AS MATERIALIZED ({assigned(k)}), m AS ({sums}), g AS ({moved}) "
            f"SELECT number, coalesce(g.c, c{k}.c) AS c FROM c{k} LEFT JOIN g USING (number))"
        )
    fits = f"len(embedding) = {size} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x) AND abs(x::DOUBLE) * 1024 <= 134217727, false)))"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE {fits}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters})),
{", ".join(steps)}, last AS MATERIALIZED ({assigned(rounds)})
SELECT vec_id, number::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY number))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{rounds} USING (number)
"""


@query("op12_mean_ordered_kmeans", _kmeans_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distance and inertia of every usable vector."""
    return mean_ordered_kmeans.cluster_vectors(table(spark, folder, "embeddings")).drop("centroid")


_MERKLE_SQL = """
WITH RECURSIVE d AS (SELECT *, ('s' || source) AS key, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(generate_series(1, 8), lambda z: z::BIGINT)), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) & 1 AS low
  FROM documents),
rows AS (SELECT doc_id, key, head || coalesce(strlen(text) || ':' || text, '-') AS whole, head || coalesce(strlen(got) || ':' || got, '-') AS received FROM (
  SELECT doc_id, key, text, CASE WHEN low = 1 THEN replace(text, chr(10), '') ELSE text END AS got,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d)),
leaves AS MATERIALIZED (SELECT doc_id, coalesce(key, '-') AS key, sha256(whole) AS leaf, sha256(received) AS received,
    row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, sha256(whole)) - 1 AS pos FROM rows),
up(key, level, pos, digest, n) AS (SELECT key, 0, pos, leaf, count(*) OVER (PARTITION BY key) FROM leaves
  UNION ALL SELECT key, level + 1, pos, digest, count(*) OVER (PARTITION BY key) FROM (
    SELECT key, level, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM up WHERE n > 1 GROUP BY key, level, pos // 3)),
tree AS MATERIALIZED (SELECT * FROM up),
subs AS MATERIALIZED (SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos FROM tree WHERE n = 1),
over(level, pos, digest, n) AS (SELECT 0, pos, subroot, count(*) OVER () FROM subs
  UNION ALL SELECT level + 1, pos, digest, count(*) OVER () FROM (SELECT level, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM over WHERE n > 1 GROUP BY level, pos // 3)),
whole AS MATERIALIZED (SELECT key, level, pos, digest, n FROM tree UNION ALL SELECT '', level, pos, digest, n FROM over),
sides AS MATERIALIZED (SELECT a.key, a.level, a.pos, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM whole a JOIN whole b ON a.key = b.key AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY ALL),
walk(id, key, level, pos, node, proof, own) AS (SELECT row_number() OVER (), key, 0, pos, received, '', key FROM leaves
  UNION ALL SELECT w.id, CASE WHEN s.n = 1 THEN '' ELSE w.key END, CASE WHEN s.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN s.n = 1 THEN u.pos ELSE w.pos // 3 END,
      CASE WHEN s.n = 1 THEN w.node ELSE sha256(s.l || w.node || s.r) END, CASE WHEN s.n = 1 THEN w.proof ELSE w.proof || s.l || s.r END, w.own
    FROM walk w JOIN sides s ON w.key = s.key AND w.level = s.level AND w.pos = s.pos LEFT JOIN subs u ON u.key = w.key WHERE NOT (w.key = '' AND s.n = 1)),
ends AS (SELECT w.* FROM walk w JOIN over o ON w.key = '' AND o.n = 1 AND w.level = o.level),
named AS (SELECT row_number() OVER () AS id, * FROM leaves)
SELECT doc_id, leaf, subroot, o.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = o.digest AS verified
FROM ends JOIN named USING (id) JOIN subs ON subs.key = own JOIN over o ON o.n = 1
"""


@query("op13_merkle_manifest", _MERKLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, proof and check of every document; every other document arrives without its line ends."""
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest.manifest(docs, {"text": text})
