import hashlib
import math
import random
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from framewise.llm import bayes_minhash, mean_ordered_kmeans, merkle_manifest, queries


# -- near duplicates --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.awkward(), plain.DOCS).repartition(3)


def clash(df, *names):
    return df.withColumns({n: F.lit(n) for n in names})


@pytest.mark.parametrize(("size", "num", "den"), [(2, 80, 100), (5, 8, 10)])
def test_near_duplicates_equal_all_pairs(docs, size, num, den):
    texts = {r[0]: r[1] for r in plain.awkward()}
    got = bayes_minhash.near_duplicates(clash(docs, "n_shingles", "component", "keys", "w0", "node"), size, num, den).collect()
    want = plain.components(texts, size, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        k: (len(plain.shingles(t, size)), want[k], want[k] == k) for k, t in texts.items()
    }


def test_chain_in_one_large_group(spark):
    base = plain.prose(5, 160).split(" ")
    rows = []
    for k in range(150):
        w = list(base)
        for j in range(k % 40):
            w[(7 * j + k) % 160] = f"new{k}x{j}"
        rows.append((k, " ".join(w)))
    got = bayes_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain.components(dict(rows), 2, 80, 100)


def test_shared_passage_links_nothing(spark):
    passage = plain.prose(1, 60)
    rows = [(k, f"{passage} {plain.prose(100 + k, 45)}") for k in range(120)] + [(500 + k, plain.prose(100 + k, 45) + " " + passage) for k in (3, 4)]
    got = bayes_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain.components(dict(rows), 2, 80, 100)


def test_pairs_at_the_threshold_itself(spark):
    rows = []
    for k in range(60):
        w = [f"a{k}x{i}" for i in range(46)]
        # 45 shingles; five changed at the end: 40 of 50 remain, exactly 0.8. Six: 39 of 51.
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join([*w[:41], *[f"b{k}x{i}" for i in range(5)]])), (3 * k + 2, " ".join([*w[6:], *[f"c{k}x{i}" for i in range(6)]]))]
    got = bayes_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain.components(dict(rows), 2, 80, 100)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (3, None), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bayes_minhash.near_duplicates(df)
    want = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (3, 1, 3, True), (None, 4, None, True)]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted((r[0] for r in bayes_minhash.without_duplicates(df, got).collect()), key=str) == [1, 3, None]
    assert bayes_minhash.near_duplicates(df.limit(0)).collect() == []


def test_posterior_bounds_lose_no_pair_at_the_threshold():
    least = bayes_minhash.least_matches(0.8, 1e-6)
    chance = (1 + 15 * 0.8) / 16
    for k, m in enumerate(least, 1):
        n = bayes_minhash.BATCH * k
        lost = sum(math.comb(n, i) * chance**i * (1 - chance) ** (n - i) for i in range(m))
        assert lost < 2e-5 and m > n * 0.3


# -- centroids --------------------------------------------------------------------------------------------------------


def test_ordered_search_equals_full_search():
    rng = np.random.default_rng(3)
    for k in (1, 2, 9, 40):
        v = rng.integers(-50, 50, (500, 6)) * rng.integers(1, 4, (500, 1))
        c = np.concatenate([v[: k - k // 2], v[: k // 2]])  # equal centroids tie
        number, distance = mean_ordered_kmeans.nearest(v, mean_ordered_kmeans.Centroids(c))
        gap = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (number == gap.argmin(axis=1)).all() and (distance == gap.min(axis=1)).all()


def test_ordered_search_at_the_limit():
    top = mean_ordered_kmeans.LIMIT - 1
    c = np.array([[top] * 64, [-top] * 64, [top] * 63 + [top - 1]])
    number, distance = mean_ordered_kmeans.nearest(c[::-1].copy(), mean_ordered_kmeans.Centroids(c))
    assert number.tolist() == [2, 1, 0] and distance.tolist() == [0, 0, 0]


def lloyd(rows, clusters=8, rounds=10):
    """Plain integer k-means over (vec_id, components)."""
    good = lambda e: e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if good(e)]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centre = [v for _, v in sorted(named)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centre = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centre)]
    last = [(i, near(v)) for i, v in kept]
    total = {}
    for _, (d, k) in last:
        total[k] = total.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, k, d, total[k], sum(total.values()), digest[k]) for i, (d, k) in last), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(64)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (900, rows[10][1])]
    rows += [(901, None), (902, [1.0] * 63), (903, [None] + [0.0] * 63), (904, [float("nan")] * 64), (905, [float("-inf")] + [0.0] * 63), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = mean_ordered_kmeans.cluster_vectors(clash(df, "cluster", "distance", "v", "centroid"))
    assert sorted(map(tuple, got.drop("centroid").collect()), key=str) == lloyd(rows)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    two = [(1, [0.5] * 64), (2, [-0.25] * 64)]
    got = mean_ordered_kmeans.cluster_vectors(spark.createDataFrame(two, schema)).drop("centroid").collect()
    assert sorted(map(tuple, got), key=str) == lloyd(two)
    for rows in ([], [(1, None)], [(None, [0.5] * 64)]):
        assert mean_ordered_kmeans.cluster_vectors(spark.createDataFrame(rows, schema)).collect() == []


# -- manifest ---------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def climb(nodes):
    """Levels up to one node, and each first node's siblings by level."""
    proofs, at, level = [([], []) for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            first = k - k % 3
            proofs[i][0].append(level[first:k])
            proofs[i][1].append(level[k + 1 : first + 3])
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], proofs


def plain_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    inside = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in sources[s]) for s in order}
    trees = {s: climb([k[2] for k, _ in inside[s]]) for s in order}
    root, above = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (k, r), own in zip(inside[s], trees[s][1], strict=True):
            left, right = own[0] + up[0], own[1] + up[1]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for a, b in zip(left, right, strict=True):
                node = h(*a, node, *b)
            proof = h(*[x for a, b in zip(left, right, strict=True) for x in a + b])
            out.append((r[0], k[2], trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest_rows(n):
    rng = random.Random(n)
    source = lambda i: None if i % 11 == 0 else "hot" if i % 3 else rng.choice(["é", "z", "Z", "", "日本", "solo" if i == 7 else "b"])
    rows = [(i * 7 % 1009, source(i), None if i % 5 == 0 else "en", None if i % 4 == 0 else i, rng.choice([None, "", "a\nb", f"{i}\n", "é\n日本", plain.prose(i, 12)])) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, "hot", None, None, "x\ny"), (None, "hot", None, None, None)] if n else []


@pytest.mark.parametrize(("n", "depth"), [(0, 2), (1, 2), (9, 2), (300, 1), (300, 2), (260, 7)])
def test_manifest_equals_plain_trees(spark, n, depth):
    rows = manifest_rows(n)
    df = clash(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4), "key", "pos", "n", "leaf", "root", "id")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle_manifest.manifest(df, {"text": text}, depth=depth).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_proofs_lead_to_the_root(spark):
    rows = manifest_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle_manifest.manifest(df, proofs=True).collect():
        assert r["verified"] and merkle_manifest.fold(r["leaf"], r["left"], r["right"]) == r["root"]


def test_new_queries_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, folder).collect()), key=str) == plain_manifest(docs)
    want = plain.components({r[0]: r[4] for r in docs}, 2, 80, 100)
    assert {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op11_bayes_minhash"](spark, folder).collect()} == want
    vectors = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_mean_ordered_kmeans"](spark, folder).collect()), key=str) == lloyd(vectors)
