"""Exact Jaccard join over word shingles by parity sketches.

A text's set holds its distinct shingles of ``shingle`` words (lower-cased A-Z, split at white space); a text of
fewer words is one shingle, one without words has none. Texts link when their sets' Jaccard similarity is at least
``num / den``.

Each set is XOR-hashed into a bit sketch: a shingle flips one bit, so the Hamming distance of two sketches is at
most the size of the sets' symmetric difference. Linked sets of one size band differ in at most D shingles, so
when sketches of the band have more than D parts, one part is equal (pigeonhole). A part is a bitmap wide enough
that its shingles do not meet, kept as the XOR of one random word for each set bit. Sets emit a key for each part
that is not zero; equal keys make candidates. A set with too few non-zero parts for the pigeonhole also emits its
zero parts, which only another such set needs; as unrelated sets meet in zero parts, a band has enough parts to make such
sets rare. Candidates pass the size bound, then the Hamming bound on a second sketch of 512 bits, then the same bound on
a sketch as wide as the set asks for, then an exact count over whole texts.

Texts with equal sets are one node from the start, and groups of equal keys with the same nodes are one group.
Within a group the smallest node is compared with the others; groups whose nodes the links found so far do not
connect go on with the next 8, 64, 512 ... nodes, each against nodes of other components, until comparing the rest
in full takes at most ``FULL`` comparisons a row. So no link between components is missed, and groups that links connect,
however large, are never expanded into their pairs.

Defined cases: null and empty texts link with nothing; a row without doc_id gets its set size and no component;
rows that share a doc_id are one node of the graph with several sets. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.components import connected_components
from framewise.llm.storage import arrow_batches, mapped, shared_folder, shuffles_removed, stored, texts
from framewise.llm.words import U64, mix, windows, word_runs

SHINGLE, NUM, DEN = 4, 85, 100
SKETCH_BITS = 512
#: Nodes whose ids may be broadcast to filter the texts to verify: 8 bytes each, 16 MB.
BROADCAST_IDS = 2_000_000
#: Groups are compared in full once that makes at most so many pairs for each of their rows.
FULL = 200
#: Identities of sets that a task remembers, to leave out the keys of copies.
SEEN = 50_000
#: Pairs whose texts are compared at a time, or an eighth of the rows if that is more.
PORTION = 20_000
#: Deviations by which the non-zero parts of a set pass the pigeonhole's number: one set in some 30,000 falls short.
MARGIN = 4
_SEED = U64(0xA0761D6478BD642F)
_ZERO = U64(0xE7037ED1A0B428DB)


class Bands:
    """Size bands and the number of sketch parts of each, for one threshold."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(starts[-1] * den * den // (num * num) + 1)
        self.starts = np.array(starts, np.int64)
        self.most = [self.differences(hi + hi * den // num) for hi in (int(x) - 1 for x in starts[1:])]
        self.parts = [self.enough(int(lo), most) for lo, most in zip(starts, self.most, strict=False)]

    @staticmethod
    def enough(least: int, most: int) -> int:
        """Parts of a band whose smallest sets hold ``least`` shingles: more than ``most`` are not zero but in rare sets.

        The number of non-zero parts is ``MARGIN`` deviations above ``most``, which takes at most as many parts as fit the shingles;
        a band whose sets may hold no more than ``most`` shingles cannot have that.
        """
        parts = most + 1 + (most // 12 + 2 if most else 0)
        while most and most < least and parts < 2 * least:
            empty = math.exp(-least / parts)
            spread = math.sqrt(parts * empty * max(0.0, 1 - (1 + least / parts) * empty))
            if parts * (1 - empty) - MARGIN * spread > most:
                break
            parts += 1 + parts // 64
        return parts

    def differences(self, sizes: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> range:
        """Bands of the smaller sets that a set of this size can link with, its own last."""
        least = -(-size * self.num // self.den)
        first, last = np.searchsorted(self.starts, [least, size], "right") - 1
        return range(int(first), int(last) + 1)


def part_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the non-zero parts of a sorted set in each of its bands, and of zero parts where those are needed."""
    found = []
    words = mix(shingles ^ _SEED)
    for band in bands.of(len(shingles)):
        most = bands.most[band]
        parts = bands.parts[band]
        part = ((shingles >> U64(32)) * U64(parts)) >> U64(32)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        value = np.bitwise_xor.reduceat(words, begin)
        place = mix((part[begin] << U64(16)) + U64(band))
        found.append(mix(value ^ place))
        if len(begin) <= most:
            empty = np.setdiff1d(np.arange(parts, dtype=U64), part[begin])
            found.append(mix(mix((empty << U64(16)) + U64(band)) ^ _ZERO))
    return np.concatenate(found)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for run in word_runs(column):
        ends = np.cumsum(run.count)
        hashed = windows(run.hash, size)
        for n, end in zip(run.count.tolist(), ends.tolist(), strict=True):
            if n >= size:
                yield np.unique(hashed[end - n : end - size + 1])
            elif n:
                yield windows(run.hash[end - n : end], n) ^ U64(n)
            else:
                yield np.zeros(0, U64)


_SIGNED = pa.list_(pa.int64())
_SIGNATURE = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("id_a", pa.int64()), ("id_b", pa.int64()), ("sketch", _SIGNED), ("keys", _SIGNED)]
)
_SIGNATURE_SQL = "doc_id long, n_shingles long, id_a long, id_b long, sketch array<long>, keys array<long>"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    odd = np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """A sketch of two to four bits a shingle, a power of two, so that it refutes pairs of sets of any size."""
    return _sketch(shingles, max(SKETCH_BITS, 1 << (2 * len(shingles) - 1).bit_length()))


def differing_bits(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches, the wider one folded to the width of the other."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def set_signatures(docs: DataFrame, shingle: int, num: int, den: int, keys: bool = True) -> DataFrame:
    """Per row of docs: set size, two words that identify the set, its sketch, and the keys of its parts if wanted.

    Keys are left out for a set that came before in the same task (it remembers about ``SEEN``), as its identity links it already; a row
    whose keys do not count, such as one without doc_id, must therefore not be given with those whose keys do.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, none = Bands(num, den), np.zeros(0, U64)
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for s in shingle_sets(batch.column(1), shingle):
                one, two = int(np.add.reduce(mix(s))), int(np.bitwise_xor.reduce(mix(s + _SEED)))
                new = keys and len(s) and (len(s), one, two) not in seen
                seen.add((len(s), one, two))
                for column, x in zip(out, (len(s), one, two, _sketch(s), part_keys(s, bands) if new else none), strict=True):
                    column.append(x)
            size = np.array(out[0], np.int64)
            ids = [np.array(x, U64).view(np.int64) for x in out[1:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size), *map(pa.array, ids), _lists(out[3]), _lists(out[4])], schema=_SIGNATURE
            )

    return mapped(texts(docs), sign, _SIGNATURE_SQL)


def _similar_stored(pairs: DataFrame, docs: DataFrame, rows: int, shingle: int, num: int, den: int, folder: str) -> DataFrame:
    """``_similar`` of the stored pairs that wide sketches do not refute, portion by portion: a pair moves two texts, and the shuffle
    files of a portion, whose texts take a quarter of all ``rows`` or less, go before the next one begins."""
    pairs = stored(_unrefuted(pairs, docs, shingle, num, den, folder), folder)
    portions = max(1, math.ceil(pairs.count() / max(PORTION, rows // 8)))
    spot = F.pmod(F.xxhash64("a", "b"), F.lit(portions))
    return reduce(
        DataFrame.union, [stored(_similar(pairs.where(spot == i), docs, shingle, num, den), folder) for i in range(portions)]
    )


def _unrefuted(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, folder: str) -> DataFrame:
    """Of pairs (a, b), those whose sets may reach the threshold by their sizes and wide sketches.

    The sketches in the join's condition say nothing of sets that flip each of their bits; these grow with the set and take
    about a twentieth of the texts' room.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("wide", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, wide = [], []
            for s in shingle_sets(batch.column(1), shingle):
                sizes.append(len(s))
                wide.append(wide_sketch(s).tobytes())
            columns = [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, o, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 4)), batch.column(3), batch.column(5), strict=True):
                apart = differing_bits(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64))
                keep.append(min(n, o) * den >= max(n, o) * num and apart * (den + num) <= (n + o) * (den - num))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sketches = stored(mapped(_needed(pairs, docs), sign, "doc_id long, n long, wide binary"), folder)
    side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
    return mapped(joined, compare, "a long, b long").distinct()


def _needed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of the documents in pairs."""
    ids = stored_ids(pairs)
    return texts(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose texts' sets reach the threshold, counted exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = _needed(pairs, docs)
    side = lambda k: text.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return mapped(joined, count, "a long, b long").distinct()


def stored_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


_WORDS = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def _close(members: DataFrame, others: DataFrame, bands: Bands) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members and others that share a key, lie in different components, and pass the
    size bound and the Hamming bound. The bounds are part of the join, so no other pair becomes a row."""
    same = [c for c in others.columns if c != "key"]
    right = others.select("key", *[F.col(c).alias(f"o_{c}") for c in same])
    n, o = F.col("n_shingles"), F.col("o_n_shingles")
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"o_{w}"))) for w in _WORDS])
    near = bits * (bands.den + bands.num) <= (n + o) * (bands.den - bands.num)
    sized = F.least(n, o) * bands.den >= F.greatest(n, o) * bands.num
    apart = (F.col("node") != F.col("o_node")) & (F.col("component") != F.col("o_component"))
    left = members.withColumnRenamed("key", "_key")
    joined = left.join(right, (F.col("_key") == F.col("key")) & apart & sized & near)
    return joined.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = shared_folder(spark)
    with shuffles_removed(spark):
        signed, parts = _signed_parts(docs, shingle, num, den, folder)
    out = signed.select("doc_id", "n_shingles").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _signed_parts(docs: DataFrame, shingle: int, num: int, den: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored signatures, without keys, and the component of each linked node."""
    bands = Bands(num, den)
    # The keys take more room than the texts: they are made once more for their one exchange rather than stored.
    signed = stored(set_signatures(docs, shingle, num, den, keys=False).drop("keys"), folder)
    rows = signed.count()
    identity = ["n_shingles", "id_a", "id_b"]
    real = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = stored(real.groupBy(*identity).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), folder)
    links = real.select("doc_id", *identity).join(nodes.select("node", *identity), identity)
    links = stored(links.select(F.col("node").alias("a"), F.col("doc_id").alias("b"), *identity), folder)
    same = links.select("a", "b").where(F.col("a") != F.col("b"))

    # Keys meet in one exchange that both sides of the join read; a group is live when it has two ids.
    full = set_signatures(docs.where(F.col("doc_id").isNotNull()), shingle, num, den).where(F.col("n_shingles") > 0)
    keyed = full.select(F.explode("keys").alias("key"), F.col("doc_id").alias("b")).repartition("key")
    ends = keyed.groupBy("key").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high").select("key")
    live = stored(keyed.join(ends.hint("shuffle_hash"), "key"), folder)
    owner = links.select("b", "a").distinct()
    words = [F.get("sketch", F.lit(i)).alias(w) for i, w in enumerate(_WORDS)]
    facts = nodes.select("node", "n_shingles", *words)
    members = live.join(owner, "b").select("key", F.col("a").alias("node")).distinct()
    members = stored(_distinct_groups(members).join(facts, "node").withColumn("component", F.col("node")), folder)

    hubs, parts = 1, stored(same.distinct(), folder)
    parts = connected_components(parts, folder) if members.isEmpty() else parts
    first = True
    while not members.isEmpty():
        ranked = members.withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy("node")))
        others = ranked.where(F.col("_rank") <= hubs).drop("_rank") if hubs else members
        found = _similar_stored(stored(_close(members, others, bands), folder), docs, rows, shingle, num, den, folder)
        if first:
            parts, first = connected_components(parts.union(found), folder), False
        elif not found.isEmpty():
            parts = _joined(parts, found, folder)
        if not hubs:
            break
        rest = ranked.where(F.col("_rank") > hubs).drop("_rank", "component")
        members = stored(_unresolved(rest, parts), folder)
        counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
        totals = counts.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"), F.sum("c").alias("c"))
        work = totals.agg(F.sum("p").alias("p"), F.sum("c").alias("c")).first()
        hubs = 0 if work["c"] is not None and work["p"] <= FULL * work["c"] else 8 * hubs
    return signed, parts


def _joined(parts: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """Components after more links: those of the components that the links join."""
    end = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    linked = found.join(end("a"), "a", "left").join(end("b"), "b", "left")
    more = linked.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = connected_components(more, folder)
    new = merged.select("node").join(parts.select("node"), "node", "left_anti")
    old = parts.select("node", "component").union(new.select("node", F.col("node").alias("component")))
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stored(old.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), folder)


def _distinct_groups(members: DataFrame) -> DataFrame:
    """Of groups (key) with the same nodes, one."""
    hashed = F.xxhash64("node")
    marks = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    one = marks.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return members.join(one.select("key"), "key", "left_semi")


def _unresolved(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members, with their components, of the groups that still have two components or more."""
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(split.select("key"), "key", "left_semi")


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is their component's smallest, one row per doc_id; rows without doc_id stay."""
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
