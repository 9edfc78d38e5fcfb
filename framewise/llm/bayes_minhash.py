"""Near duplicates by MinHash bands and sequential Bayesian verification.

A text's set holds its distinct shingles of ``shingle`` words (lower-cased A-Z, split at white space); a text of fewer
words is one shingle, one without words has none. Texts link when their sets' Jaccard similarity is at least
``num / den``.

Each set is hashed by ``BANDS * ROWS`` functions; sets whose minima agree on all ``ROWS`` functions of a band are
candidates. A pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40, about 10 ** -7. The lowest four bits of
the first ``BATCH * BATCHES`` minima are the signature by which candidates are compared, batch by batch: with m of n
positions equal, the posterior of the similarity (uniform prior) says how likely it still reaches the threshold, and a
pair below the miss probability is dropped before the next batch. The batches are one conjunction in the join's
condition, so a pruned pair never becomes a row.

What survives is verified exactly, in two steps. Each set also has a sketch in which every shingle flips one of
``PARITY`` bits; two sketches differ in at most as many bits as the sets in shingles, so more differing bits than the
threshold allows refute a pair for certain. This test ends the join's condition; groups whose members are just below the
threshold would make a row for each of their pairs without it. The other pairs are counted over the whole texts. A
pair that shares several bands is compared in the bucket with the smallest key alone.

Texts with equal sets are one node from the start. In a band's bucket the smallest node is compared with the others;
buckets whose nodes the links found so far do not connect go on with the next 8, 64, 512 ... nodes, until comparing the
rest in full takes at most ``FULL`` comparisons a row. A bucket of copies, however large, is never expanded into its pairs.

Defined cases: null and empty texts link with nothing and are kept; a row without doc_id gets its set size, no
component, and is kept; rows that share a doc_id are one node with several sets; an empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.components import connected_components
from framewise.llm.storage import arrow_batches, mapped, shared_folder, stored, texts
from framewise.llm.words import U64, mix, windows, word_runs

SHINGLE, NUM, DEN = 2, 80, 100
BANDS, ROWS = 40, 5
#: Positions compared before each look at the posterior, 16 to a 64-bit word of the signature.
BATCH, BATCHES = 32, 4
#: Chance below which a pair is taken to miss the threshold.
MISS = 1e-6
#: Bits of the sketch that refutes pairs.
PARITY = 1024
#: Buckets are compared in full once that makes at most so many pairs for each of their rows.
FULL = 200
#: Ids that may be broadcast to filter the texts to verify, 8 bytes each.
BROADCAST_IDS = 250_000
#: Shingles hashed at once; bounds the working table at any length of text.
_STEP = 1024

_random = np.random.Generator(np.random.PCG64(11))
_FLIP = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(U64) * U64(2)
_SPREAD = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U64))
_SEED = U64(0xC2B2AE3D27D4EB4F)
_WORDS = [f"w{i}" for i in range(BATCH * BATCHES // 16)]
_BITS = [f"p{i}" for i in range(PARITY // 64)]


def least_matches(threshold: float, miss: float, batch: int = BATCH, batches: int = BATCHES) -> list[int]:
    """After each batch, the fewest equal positions with which the threshold is still likelier than ``miss``.

    Four-bit values of unequal minima agree once in 16, so a position agrees with chance c = (1 + 15 s) / 16.
    """
    s = np.linspace(0, 1, 20_001)
    c = np.clip((1 + 15 * s) / 16, 1e-12, 1 - 1e-12)
    reached = s >= threshold
    least = []
    for n in range(batch, batch * batches + 1, batch):
        for m in range(n + 1):
            log = m * np.log(c) + (n - m) * np.log(1 - c)
            weight = np.exp(log - log.max())
            if weight[reached].sum() >= miss * weight.sum():
                least.append(m)
                break
        else:
            least.append(n)
    return least


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = np.full(BANDS * ROWS, ~U64(0))
    for i in range(0, len(shingles), _STEP):
        table = (shingles[i : i + _STEP, None] ^ _FLIP) * _SPREAD
        np.minimum(low, table.min(axis=0), out=low)
    return low


def signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed four-bit values of a set's minima."""
    high = low >> U64(24)
    keys = _BAND.copy()
    for j in range(ROWS):
        keys = mix(keys ^ high[j::ROWS])
    nibbles = ((low[: BATCH * BATCHES] >> U64(40)) & U64(15)).reshape(-1, 16)
    packed = np.bitwise_or.reduce(nibbles << (U64(4) * np.arange(16, dtype=U64)), axis=1)
    return keys, packed


def parity(shingles: np.ndarray) -> np.ndarray:
    """Which of ``PARITY`` bits an odd number of shingles fall on."""
    odd = np.bincount((shingles & U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    for run in word_runs(column):
        last = np.cumsum(run.count)
        hashed = windows(run.hash, size)
        for n, end in zip(run.count.tolist(), last.tolist(), strict=True):
            if n >= size:
                yield np.unique(hashed[end - n : end - size + 1])
            elif n:
                yield windows(run.hash[end - n : end], n) ^ U64(n)
            else:
                yield np.zeros(0, U64)


_SIGNED = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("id_a", pa.int64()), ("id_b", pa.int64()), ("keys", pa.list_(pa.int64()))]
_SCHEMA = pa.schema([*_SIGNED, *[(w, pa.int64()) for w in (*_WORDS, *_BITS)]])
_SCHEMA_SQL = "doc_id long, n_shingles long, id_a long, id_b long, keys array<long>, " + ", ".join(f"{w} long" for w in (*_WORDS, *_BITS))


def sign_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row of docs: set size, two words that identify the set, its band keys, signature and sketch.

    A set met before in the same Arrow batch goes without keys, as its identity links it already.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, wide = np.zeros(0, U64), len(_WORDS) + len(_BITS)
        blank = np.zeros(wide, U64)
        for batch in batches:
            n = batch.num_rows
            ids, packed, keys = np.zeros((3, n), U64), np.zeros((wide, n), U64), []
            seen: dict[tuple[int, int, int], np.ndarray] = {}
            for i, s in enumerate(shingle_sets(batch.column(1), shingle)):
                one, two = np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(s ^ _SEED)) if len(s) else U64(0)
                ids[:, i] = len(s), one, two
                own, known = (len(s), int(one), int(two)), none
                if len(s) and own not in seen:
                    known, values = signature(minima(s))
                    seen[own] = np.concatenate([values, parity(s)])
                packed[:, i] = seen.get(own, blank)
                keys.append(known)
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            flat = np.concatenate([none, *keys]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [batch.column(0).cast(pa.int64()), *[pa.array(x.view(np.int64)) for x in ids], lists]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.view(np.int64)) for x in packed]], schema=_SCHEMA)

    return mapped(texts(docs), sign, _SCHEMA_SQL)


def _likely(num: int, den: int, miss: float) -> Column:
    """The batches in order: a pair goes on to the next while its matches leave the threshold possible."""
    nibbles = F.lit(0x1111111111111111)

    def equal(word: str) -> Column:
        x = F.col(word).bitwiseXOR(F.col(f"o_{word}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return 16 - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(nibbles))

    words, tests, step = [equal(w) for w in _WORDS], [], BATCH // 16
    for k, least in enumerate(least_matches(num / den, miss), 1):
        tests.append(reduce(lambda x, y: x + y, words[: k * step]) >= least)
    return reduce(lambda x, y: x & y, tests)


def _possible(num: int, den: int) -> Column:
    """Whether the sketches leave the threshold possible."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"o_{b}"))) for b in _BITS])
    return bits * (den + num) <= (F.col("n_shingles") + F.col("o_n_shingles")) * (den - num)


def _candidates(members: DataFrame, others: DataFrame, num: int, den: int, miss: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members and others in one bucket but different components, within the size bound,
    not pruned by any batch, not refuted by the sketches, and without a smaller key in common."""
    # No value is null; where Spark knows that, the condition's code is short enough to be compiled by the JVM.
    sure = lambda c: F.col(c) if c == "earlier" else F.coalesce(c, F.lit(0).cast("long"))
    right = others.select("key", *[sure(c).alias(f"o_{c}") for c in others.columns if c != "key"])
    left = members.select(F.col("key").alias("_key"), *[sure(c).alias(c) for c in members.columns if c != "key"])
    n, o = F.col("n_shingles"), F.col("o_n_shingles")
    sized = F.least(n, o) * den >= F.greatest(n, o) * num
    apart = (F.col("node") != F.col("o_node")) & (F.col("component") != F.col("o_component"))
    new = ~F.arrays_overlap("earlier", "o_earlier")
    joined = left.join(right, (F.col("_key") == F.col("key")) & apart & sized & _likely(num, den, miss) & _possible(num, den) & new)
    return joined.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets reach the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    text = texts(docs).join(needed, "doc_id", "left_semi")
    side = lambda k: text.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return mapped(joined, count, "a long, b long").distinct()


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their components, of buckets that still hold two components or more."""
    placed = members.drop("component").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(open_.select("key"), "key", "left_semi")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, miss: float = MISS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept."""
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = shared_folder(spark)
    signed = stored(sign_texts(docs, shingle), folder)
    identity = ["n_shingles", "id_a", "id_b"]
    real = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    owner = stored(real.groupBy(*identity).agg(F.min("doc_id").alias("node")), folder)
    links = real.select("doc_id", *identity).join(owner, identity).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = stored(links.where("a <> b").distinct(), folder)

    # A bucket's first row of each set is enough; the others are linked by identity.
    sets = real.where(F.size("keys") > 0).join(owner, identity)
    keyed = sets.select(F.explode("keys").alias("key"), "node", "id_a").repartition("key")
    ends = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    live = keyed.join(ends.hint("shuffle_hash"), "key", "left_semi").distinct()
    facts = sets.select("node", "id_a", "n_shingles", "keys", *_WORDS, *_BITS).dropDuplicates(["node", "id_a"])
    members = _one_of_equal(stored(live, folder)).join(facts, ["node", "id_a"])
    earlier = F.filter("keys", lambda k: k < F.col("key"))
    members = members.withColumns({"earlier": earlier, "component": F.col("node")}).drop("keys", "id_a")
    members = stored(members, folder)

    hubs, rest = 1, not members.isEmpty()
    while rest:
        if hubs:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            others = stored(members.withColumn("_rank", rank).where(F.col("_rank") <= hubs).drop("_rank"), folder)
        else:
            others = members
        pairs = stored(_candidates(members, others, num, den, miss), folder)
        found = stored(_verified(pairs, docs, shingle, num, den), folder)
        links = links.union(found)
        if not hubs:
            break
        past = others.groupBy("key").agg(F.max("node").alias("past"))
        later = members.join(past, "key").where(F.col("node") > F.col("past")).drop("past")
        if not later.isEmpty():
            parts = connected_components(links, folder)
            later = stored(_placed(later, parts), folder)
        members = later
        counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
        totals = counts.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"), F.sum("c").alias("c"))
        work = totals.agg(F.sum("p").alias("p"), F.sum("c").alias("c")).first()
        rest = work["c"] is not None
        hubs = 0 if rest and work["p"] <= FULL * work["c"] else 8 * hubs
    parts = connected_components(links, folder)
    out = signed.select("doc_id", "n_shingles").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _one_of_equal(members: DataFrame) -> DataFrame:
    """Of buckets with the same sets, the one with the smallest key."""
    own = lambda k: F.bit_xor(F.xxhash64("node", "id_a", F.lit(k)))
    marks = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), own(0).alias("x"), own(1).alias("y"))
    one = marks.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return members.join(one.select("key"), "key", "left_semi")


def without_duplicates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs that are kept, one for each doc_id; rows without doc_id all stay."""
    named = docs.join(found.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
