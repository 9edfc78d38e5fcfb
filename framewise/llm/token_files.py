"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK`` ids; a block stores its minimum,
and each id less that minimum in as many bits as ``SHARE`` of the block's differences need; the high bits of the
others go to an exception list of (place, rest). Layout, little-endian:

    magic "PFR1", blocks (4 bytes), documents (8), ids (8)
    per block: offset of its body (8), minimum (4), ids (4), exceptions (4), bits (1)
    per document: number of ids (4)
    per block: packed low bits, exception places (2 each), exception rests (4 each)

The index lets a reader decode any block alone. ``write_ids`` sorts documents by doc_id over the cluster, encodes them
with a tokenizer inside the tasks and writes one file or more per task to the shared folder; its manifest is a table with
a row per file. ``read_ids`` reads the files back, one task per file.

Defined cases: null and empty texts hold the end id alone; rows without doc_id come first; rows that share a doc_id keep
their own entries, ordered by text; no rows give no files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.storage import arrow_batches, shared_folder, stored
from framewise.llm.words import U64, Run, word_runs

BLOCK = 4096
SHARE = 0.9
#: A task closes a file when it holds so many ids.
FILE_IDS = 4_000_000
END_ID = 0
MAGIC = b"PFR1"
_INDEX = np.dtype([("offset", "<u8"), ("least", "<u4"), ("ids", "<u4"), ("exceptions", "<u4"), ("bits", "u1")])


def pack_block(ids: np.ndarray) -> tuple[int, int, int, bytes]:
    """(minimum, bits, exceptions, body) of a block."""
    least = int(ids.min())
    rest = ids - np.uint32(least)
    needed = np.frexp(rest.astype(float))[1]
    bits = int(np.searchsorted(np.cumsum(np.bincount(needed)), SHARE * len(rest)))
    odd = np.flatnonzero(needed > bits)
    body = [_pack(rest, bits), odd.astype("<u2").tobytes(), (rest[odd] >> np.uint32(bits)).astype("<u4").tobytes()]
    return least, bits, len(odd), b"".join(body)


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    kind = "<u2" if bits <= 16 else "<u4"
    width = np.dtype(kind).itemsize
    every = np.unpackbits(values.astype(kind).view(np.uint8).reshape(-1, width), axis=1, bitorder="little")
    return np.packbits(every[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_block(raw: memoryview, entry: np.void) -> np.ndarray:
    """Ids of a block, from the file's bytes and its index entry."""
    n, bits, odd, at = int(entry["ids"]), int(entry["bits"]), int(entry["exceptions"]), int(entry["offset"])
    size = (n * bits + 7) // 8
    values = np.zeros(n, "<u4")
    if bits:
        packed = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * bits, bitorder="little")
        kind = np.dtype("<u2" if bits <= 16 else "<u4")
        wide = np.zeros((n, 8 * kind.itemsize), np.uint8)
        wide[:, :bits] = packed.reshape(n, bits)
        values = np.packbits(wide, axis=1, bitorder="little").view(kind).ravel().astype("<u4")
    if odd:
        places = np.frombuffer(raw, "<u2", odd, at + size)
        values[places] |= np.frombuffer(raw, "<u4", odd, at + size + 2 * odd) << np.uint32(bits)
    return values + np.uint32(entry["least"])


def pack_file(ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """A file's bytes in pieces."""
    starts = range(0, len(ids), BLOCK)
    blocks = [pack_block(ids[a : a + BLOCK]) for a in starts]
    index = np.zeros(len(blocks), _INDEX)
    head = len(MAGIC) + 20
    at = head + index.nbytes + 4 * len(counts)
    for k, (a, (least, bits, odd, body)) in enumerate(zip(starts, blocks, strict=True)):
        index[k] = at, least, min(BLOCK, len(ids) - a), odd, bits
        at += len(body)
    yield MAGIC + len(blocks).to_bytes(4, "little") + len(counts).to_bytes(8, "little") + len(ids).to_bytes(8, "little")
    yield index.tobytes()
    yield counts.astype("<u4").tobytes()
    for *_, body in blocks:
        yield body


class IdFile:
    """A file's counts per document and its ids, block by block."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("Not a token-id file")
        self.raw = memoryview(raw)
        blocks, docs = int.from_bytes(raw[4:8], "little"), int.from_bytes(raw[8:16], "little")
        self.index = np.frombuffer(raw, _INDEX, blocks, 24)
        self.counts = np.frombuffer(raw, "<u4", docs, 24 + self.index.nbytes)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` - 1 of the file, from the blocks that hold them."""
        a, b = first // BLOCK, -(-last // BLOCK)
        parts = [unpack_block(self.raw, e) for e in self.index[a:b]]
        return np.concatenate([*parts, np.zeros(0, "<u4")])[first - a * BLOCK : last - a * BLOCK]


#: White space of the tokenizer's pattern other than single spaces and line feeds between other characters.
_OTHER_SPACE = re.compile(r"[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  | \n|\n |^ | $")
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
#: First two bytes of the characters beyond ASCII that the pattern takes for white space.
_WIDE_SPACE = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII beside letters, the space and the apostrophe.
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(0x80) if not _LETTER[i] and i not in (0x20, 0x27)]] = True
_FIRST = U64(0xD6E8FEB86659FD93)
#: Words and ids that a worker keeps, about 80 MB; beyond it the store is emptied, which changes no result.
STORE, STORE_IDS = 1_500_000, 8_000_000
LEARN = 2_000


class _Known:
    """Ids of words by their hash: sorted hashes, a guard against equal hashes of other words, and runs in a pool of ids."""

    def __init__(self) -> None:
        self.key, self.guard = np.zeros(0, U64), np.zeros(0, U64)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, key: np.ndarray, guard: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 for an unknown one."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.guard[at] == guard), at, -1)

    def clash(self, key: np.ndarray) -> bool:
        """Whether one of these keys is known, if with another guard."""
        at = np.searchsorted(self.key, key)
        return bool(np.any(self.key[np.minimum(at, len(self.key) - 1)] == key)) if len(self.key) and len(key) else False

    def add(self, key: np.ndarray, guard: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Sorted keys that ``find`` doesn't know, with their ids one after the other."""
        start = len(self.pool) + np.cumsum(size) - size
        at = np.searchsorted(self.key, key)
        self.key, self.guard = np.insert(self.key, at, key), np.insert(self.guard, at, guard)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.pool = np.concatenate([self.pool, ids])


class WordEncoder:
    """Byte-level BPE of texts by the library, word by word: ids of the pieces between cuts are kept.

    A byte-level pattern always begins a new piece at a single space between two characters that are not white space,
    between an ASCII letter and an ASCII mark or digit (the apostrophe apart), and before line feeds, so a text's ids are
    those of its parts cut there. Texts with other white space around a space, or with one of the tokenizer's added
    words, go to the library whole, as do all texts where the tokenizer is of another kind. New words that follow a space
    are given to the library joined; a piece that begins with a space begins the next word.
    """

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.cuts = word_by_word(tokenizer)
        self.added = [t["content"].encode() for t in json.loads(tokenizer).get("added_tokens") or []]
        begins = [i for piece, i in self.library.get_vocab().items() if piece.startswith("Ġ")]
        self.begins = np.zeros(1 + max(self.library.get_vocab().values(), default=0), bool)
        self.begins[begins] = True
        self.known = _Known()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, and their number for each row; null counts as empty."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for run in word_runs(column, _NOT_BLANK, lower=False, cuts=_cuts):
            if self.cuts:
                whole = _odd_rows(run, self.added)
            else:
                whole = np.diff(run.offsets) > 0
            got = self._words(run, ~whole[run.row])
            each = np.bincount(run.row[~whole[run.row]], got[0], run.rows).astype(np.int64)
            flat = got[1]
            if whole.any():
                flat, each = self._with_whole(run, whole, flat, each)
            ids.append(flat)
            counts.append(each)
        return np.concatenate(ids), np.concatenate(counts)

    def _with_whole(self, run: Run, whole: np.ndarray, flat: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(whole)
        texts = [run.data[run.offsets[i] : run.offsets[i + 1]].tobytes().decode() for i in rows]
        begin, parts, last = np.cumsum(each) - each, [], 0
        each = each.copy()
        for i, e in zip(rows.tolist(), self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            parts += [flat[last : begin[i]], np.array(e.ids, "<u4")]
            each[i], last = len(e.ids), begin[i]
        return np.concatenate([*parts, flat[last:]]), each

    def _words(self, run: Run, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each taken word, and these ids."""
        start, end, row = run.start[taken], run.end[taken], run.row[taken]
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        first = (start == run.offsets[row]) | (run.data[start - 1] != 0x20)
        key, at, back = np.unique(run.hash[taken] ^ np.where(first, _FIRST, U64(0)), return_index=True, return_inverse=True)
        start, end, first = start[at], end[at], first[at]
        guard = _guard(run.data, start, end)
        if len(self.known.key) + len(key) > STORE or len(self.known.pool) > STORE_IDS:
            self.known = _Known()
        for head in (False, True):
            new = np.flatnonzero((self.known.find(key, guard) < 0) & (first == head))
            if self.known.clash(key[new]):
                # Another word with the same hash is known: start anew with these.
                self.known = _Known()
                return self._words(run, taken)
            self.known.add(key[new], guard[new], *self._learn(run.data, start[new], end[new], head))
        slot = self.known.find(key, guard)[back]
        return self.known.size[slot], _gather(self.known.pool, self.known.start[slot], self.known.size[slot])

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, head: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and these ids, in order; ``head`` for words without a space before them."""
        raw, sizes, ids = data.tobytes(), [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        words = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        for a in range(0, len(words), LEARN):
            part = words[a : a + LEARN]
            texts = part if head else [" " + " ".join(part)]
            got = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            ids += got
            begins = np.flatnonzero(self.begins[got[0]])
            sizes.append(np.array([len(x) for x in got]) if head else np.diff(begins, append=len(got[0])))
        return np.concatenate(sizes), np.concatenate(ids)


def word_by_word(tokenizer: str) -> bool:
    """Whether texts may be cut at single spaces: byte-level BPE with the usual pattern, no normaliser and no prefix."""
    spec = json.loads(tokenizer)
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    # Words that the library matches before cutting may hold spaces or take those beside them.
    simple = not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens") or [])
    return bool(plain and usual and simple and "Ġ" in (model.get("vocab") or {}))


def _cuts(data: np.ndarray) -> np.ndarray:
    """Bytes at which a new piece begins without a space before it."""
    letter, mark, line = _LETTER[data], _MARK[data], data == 0x0A
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:] & ~line[:-1]) | (line[1:] & ~line[:-1])
    return cut


def _odd_rows(run: Run, added: list[bytes]) -> np.ndarray:
    """Rows whose white space isn't only single spaces and line feeds between other characters, or that hold an added word."""
    data, offsets = run.data, run.offsets
    odd = np.zeros(run.rows, bool)
    if not len(data):
        return odd
    row_of = lambda places: np.searchsorted(offsets, places, "right") - 1
    filled = np.flatnonzero(np.diff(offsets) > 0)
    odd[filled] = (data[offsets[filled]] == 0x20) | (data[offsets[filled + 1] - 1] == 0x20)
    space, gap = data == 0x20, _BREAK[data]
    odd[row_of(np.flatnonzero((space[:-1] & gap[1:]) | (gap[:-1] & space[1:])))] = True
    odd[row_of(np.flatnonzero(_ODD_BYTE[data]))] = True
    raw = data.tobytes()
    for word in added:
        at = raw.find(word)
        while at >= 0:
            odd[row_of(at)] = True
            at = raw.find(word, at + len(word))
    wide: list[np.ndarray] = []
    high = np.flatnonzero(data[:-1] >= 0xC2)
    for lead, seconds in _WIDE_SPACE.items():
        led = high[data[high] == lead]
        wide.append(led[np.isin(data[led + 1], seconds)])
    for i in np.unique(row_of(np.concatenate(wide))).tolist():
        odd[i] |= bool(_OTHER_SPACE.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return odd


def _guard(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length and last four bytes of each word."""
    guard = (end - start).astype(U64)
    for k in range(1, 5):
        at = end - k
        guard = (guard << U64(8)) | np.where(at >= start, data[np.maximum(at, 0)], 0).astype(U64)
    return guard


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of a pool one after the other."""
    if not len(size):
        return np.zeros(0, pool.dtype)
    ends = np.cumsum(size)
    return pool[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]


_encoders: dict[int, WordEncoder] = {}


def _encoder(shared) -> WordEncoder:
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(shared.value)
    return _encoders[key]


_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64())])
_MANIFEST_SQL = "part long, file long, path string, doc_ids array<long>, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts in doc_id order; the manifest has per file its place (part, file), path, doc_ids and
    number of ids. ``tokenizer`` is the content of a tokenizer file."""
    spark = docs.sparkSession
    arrow_batches(spark)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    folder = shared_folder(spark)
    shared = spark.sparkContext.broadcast(tokenizer)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered = ordered.withColumn("part", F.spark_partition_id().cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store, path = fs.FileSystem.from_uri(folder)
        encoder = _encoder(shared)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = number = part = 0

        def close() -> pa.RecordBatch:
            ids, counts = np.concatenate(held), np.concatenate(sizes)
            name = f"{path}/ids-{part:06d}-{number:04d}-{os.urandom(6).hex()}.pfr"
            with store.open_output_stream(name) as out:
                for piece in pack_file(ids, counts):
                    out.write(piece)
            row = [[part], [number], [f"{folder}/{name.rpartition('/')[2]}"], [names], [len(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, _MANIFEST, strict=True)], schema=_MANIFEST)

        for batch in batches:
            if not batch.num_rows:
                continue
            store.create_dir(path, recursive=True)
            part = batch.column(2)[0].as_py()
            for a in range(0, batch.num_rows, 500):
                ids, counts = encoder.encode(batch.column(1)[a : a + 500])
                # The end id goes behind each document's last.
                held.append(np.insert(ids, np.cumsum(counts), np.uint32(end_id)))
                sizes.append(counts + 1)
                names += batch.column(0)[a : a + 500].to_pylist()
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield close()
                    names, held, sizes, size, number = [], [], [], 0, number + 1
        if held:
            yield close()

    return stored(ordered.mapInArrow(write, _MANIFEST_SQL), folder + "-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it over all files), n_tokens and the ids' CRC-32."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the window orders files, not documents.
    starts = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    files = manifest.join(starts, ["part", "file"]).select("path", "first", "doc_ids")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, names in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner) as source:
                    file = IdFile(source.read())
                counts = file.counts.astype(np.int64)
                begin = np.cumsum(counts) - counts
                sums = []
                for a, b in _groups(counts):
                    ids = file.ids(int(begin[a]), int(begin[b - 1] + counts[b - 1])).astype("<u4").tobytes()
                    at = 4 * (begin[a:b] - begin[a])
                    sums += [zlib.crc32(ids[x : x + 4 * n]) for x, n in zip(at.tolist(), counts[a:b].tolist(), strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(begin + first), pa.array(counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _groups(counts: np.ndarray, most: int = 64 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` ids."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
