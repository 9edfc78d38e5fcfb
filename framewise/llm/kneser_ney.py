"""Interpolated modified Kneser-Ney model of word n-grams, counted in Spark and looked up in memory-mapped arrays.

Words are runs of other than white space, lower-cased (A-Z); a text ends with one end token and begins with
``order`` - 1 begin symbols, which are context only. Base scores add 0.1 to every count of words.

Counting: each task sorts its n-grams, adds equal ones up and sends them as packed blocks by a hash of the n-gram,
so a frequent n-gram reaches a shard once per block of text. A shard merges its blocks, writes the sorted hashes with
their counts to the shared folder, and sends on what the shorter n-grams need: the n-gram without its first word (a
continuation count) and its context (distinct and summed followers by count class). Shards are ranges of the hash,
so all files of a level in order are one sorted array. Their number grows with the text.

Scoring: a worker maps the files; a level's shard is found by the top bits of the hash and the entry by
binary search. Nothing of the model passes the driver but counts of counts.

Words are counted by 64-bit hashes. N-grams are sent as 48 bits of each word's hash, sorted so that the first words
compress away, and looked up by a 64-bit mix of those; two words are one word to the n-grams once in 2^48 pairs.
Counts take a byte in the arrays; the few of 255 or more are in an array of their own.
Where the shared folder is not a mounted one, workers read it through Arrow's file systems into unlinked local files,
one copy per worker for the time of its task.

Defined cases: null and empty texts are a single end token; rows with a null doc_id are trained on; repeated rows count
each; without training tokens base scores and scores are those of the uniform law over one unknown word.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.storage import arrow_batches, shared_folder, stored
from framewise.llm.words import U64, mix, word_runs

ORDER = 2
#: Text bytes for each shard of a level.
SHARD_BYTES = 32 * 1024 * 1024
#: Words of text that a task counts before it sends a block.
BLOCK_WORDS = 2_000_000
ADD = 0.1
BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
_STEP = U64(0x9FB21C651E98DF25)


def _longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its words but the last and that of the last."""
    return mix((left ^ (right >> U64(7))) * _STEP + right)


def token_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words and ends, tokens per row) of runs of rows."""
    for run in word_runs(column):
        count = run.count + 1
        hashes = np.empty(len(run.hash) + len(count), U64)
        ends = np.cumsum(count) - 1
        inner = np.ones(len(hashes), bool)
        inner[ends] = False
        hashes[inner], hashes[ends] = run.hash, END
        yield run.first, hashes, count


def _contexts(hashes: np.ndarray, count: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0 to order - 1: the words k places back, BEGIN before a text's first."""
    hashes = hashes >> U64(16)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
    back = [hashes]
    for k in range(1, order):
        x = np.full(len(hashes), BEGIN >> U64(16), U64)
        x[k:] = hashes[:-k] if k < len(hashes) else hashes[:0]
        x[place < k] = BEGIN >> U64(16)
        back.append(x)
    return back


def _spelled(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given by their words."""
    out = mix(columns[0])
    for x in columns[1:]:
        out = _longer(out, x)
    return out


def _summed(key: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows sorted by key, equal keys' values added up."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], first) if len(key) else v for v in values]
    return key[first], [c[order][first] for c in columns], sums


_BLOCK = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
_BLOCK_SQL = "level int, shard int, kind int, block binary"
_NGRAM, _CONTEXT = 0, 1


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length as a compressed Arrow stream; keys are sorted, so their high bytes compress away."""
    table = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in arrays], names=[str(i) for i in range(len(arrays))])
    planes = pa.BufferOutputStream()
    with pa.CompressedOutputStream(planes, "zstd") as out:
        for column in table.columns:
            raw = np.frombuffer(column.buffers()[1], np.uint8)[: 8 * len(column)].reshape(-1, 8)
            out.write(np.ascontiguousarray(raw.T).tobytes())
    return len(arrays).to_bytes(4, "little") + table.num_rows.to_bytes(8, "little") + planes.getvalue().to_pybytes()


def _unpacked(block: bytes) -> list[np.ndarray]:
    width, rows = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:12], "little")
    raw = pa.CompressedInputStream(pa.BufferReader(block[12:]), "zstd").read()
    planes = np.frombuffer(raw, np.uint8).reshape(width, 8, rows)
    return [np.ascontiguousarray(p.T).view(U64).ravel() for p in planes]


def _blocks(level: int, kind: int, key: np.ndarray, columns: list[np.ndarray], bits: int, words: list[np.ndarray] | None = None) -> Iterator[tuple]:
    """Rows sorted by key, cut into a block for each shard (the key's top bits). N-grams of two words or more go as their
    words in order, and the key is worked out again."""
    shard = (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    if words:
        order = np.lexsort([*words[::-1], shard])
        sent = [x[order] for x in (*words, *columns)]
    else:
        sent = [key, *columns]
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(key) else []
    for a, b in zip(first, [*first[1:], len(key)], strict=True):
        yield level, int(shard[a]), kind, _packed([x[a:b] for x in sent])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _BLOCK.field(i).type) for i in range(4)], schema=_BLOCK)


def _count(order: int, bits: int):
    """Text batches to blocks of n-grams of the highest order (key, words, count), and of words with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        every: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            back = [np.concatenate(x) for x in zip(*held, strict=True)]
            words = back[::-1]
            key, columns, (n,) = _summed(_spelled(words), words, [np.ones(len(words[0]), U64)])
            for row in _blocks(order, _NGRAM, key, [n], bits, columns if order > 1 else None):
                yield _batch([row])
            tokens = np.concatenate(every)
            word, _, (n,) = _summed(tokens, [], [np.ones(len(tokens), U64)])
            for row in _blocks(0, _NGRAM, word, [n], bits):
                yield _batch([row])

        for batch in batches:
            for _, hashes, counts in token_runs(batch.column(0)):
                held.append(_contexts(hashes, counts, order))
                every.append(hashes)
                size += len(hashes)
                if size >= BLOCK_WORDS:
                    yield from flush()
                    held, every, size = [], [], 0
        if held:
            yield from flush()

    return count


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays of 8, 4 ... bytes an entry one after another. A retried task writes the same bytes again: the name goes to the
    file only when it is complete."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(temporary) as out:
        for x in arrays:
            out.write(x.tobytes())
    store.move(temporary, f"{path}/{name}")


def _merge(order: int, bits: int, folder: str):
    """One shard of one level, from its blocks: writes its file and sends blocks for contexts and the level below."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        level, shard, kind = (int(k.as_py()) for k in key)
        parts = [_unpacked(b) for b in table.column("block").to_pylist()]
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        rows: list[tuple] = []
        counts = np.zeros(4, np.int64)
        if kind == _CONTEXT:
            context, _, sums = _summed(merged[0], [], merged[1:])
            _write(folder, f"context-{level}-{shard:06d}", [context, *[s.astype(np.uint32) for s in sums[:3]], sums[3].astype(np.uint64)])
        elif level == 0:
            word, _, (n,) = _summed(merged[0], [], merged[1:])
            _write(folder, f"word-0-{shard:06d}", [word, n])
            counts[:2] = len(word), int(n.sum())
        else:
            words = merged[:-1] if level > 1 else []
            ngram, words, (n,) = _summed(_spelled(words) if words else merged[0], words, merged[-1:])
            _write(folder, f"ngram-{level}-{shard:06d}", [ngram, np.minimum(n, U64(255)).astype(np.uint8)])
            many = n >= 255
            _write(folder, f"many-{level}-{shard:06d}", [ngram[many], n[many]])
            counts = np.array([(n == k).sum() for k in range(1, 5)], np.int64)
            one = [(n == 1).astype(U64), (n == 2).astype(U64), (n >= 3).astype(U64), n]
            context, _, sums = _summed(_spelled(words[:-1]) if words else np.zeros(len(ngram), U64), [], one)
            rows += _blocks(level, _CONTEXT, context, sums, bits if words else 0)
            if words:
                shorter = words[1:]
                suffix, columns, (m,) = _summed(_spelled(shorter), shorter, [np.ones(len(ngram), U64)])
                rows += _blocks(level - 1, _NGRAM, suffix, [m], bits, columns if level > 2 else None)
        rows.append((level, shard, -1, counts.tobytes()))
        return pa.Table.from_batches([_batch(rows)])

    return merge


class Model:
    """Where a model's files are, and its few numbers: shards (bits), order, words, tokens, discounts by level."""

    def __init__(self, folder: str, bits: int, order: int, words: int, tokens: int, discounts: dict[int, list[float]]) -> None:
        self.folder, self.bits, self.order, self.words, self.tokens, self.discounts = folder, bits, order, words, tokens, discounts


def _discounts(n: list[int]) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more from the numbers of n-grams with counts 1 to 4; 0.5, 1 and 1.5 where
    those are too few for the estimate."""
    plain = [0.5, 1.0, 1.5]
    if min(n[:3]) <= 0:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return [f if 0 <= f <= k + 1 else plain[k] for k, f in enumerate(found)]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the texts of docs into a model in a new shared folder."""
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = shared_folder(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (int(size) // SHARD_BYTES).bit_length())
    blocks = docs.select("text").mapInArrow(_count(order, bits), _BLOCK_SQL)
    numbers: dict[int, np.ndarray] = {}
    for level in range(order, 0, -1):
        merged = stored(blocks.where("kind >= 0").groupBy("level", "shard", "kind").applyInArrow(_merge(order, bits, folder), _BLOCK_SQL), folder)
        for row in merged.where("kind = -1").select("level", "block").collect():
            numbers[row["level"]] = numbers.get(row["level"], 0) + np.frombuffer(row["block"], np.int64)
        blocks = merged
    stored(blocks.where("kind >= 0").groupBy("level", "shard", "kind").applyInArrow(_merge(order, bits, folder), _BLOCK_SQL), folder)
    words, tokens = (int(x) for x in numbers.get(0, np.zeros(4, np.int64))[:2])
    return Model(folder, bits, order, words, tokens, {k: _discounts(numbers[k].tolist()) for k in numbers if k})


class Arrays:
    """A level's files, mapped: sorted hashes and the columns beside them, shard by shard."""

    def __init__(self, folder: str, name: str, bits: int, kinds: list) -> None:
        self.bits, self.kinds = bits, kinds
        self.shards: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        width = 8 + sum(np.dtype(k).itemsize for k in kinds)
        for shard in range(1 << bits):
            raw = _mapped(f"{folder}/{name}-{shard:06d}")
            if raw is not None and len(raw):
                n = len(raw) // width
                key, at, columns = raw[: 8 * n].view(U64), 8 * n, []
                for kind in kinds:
                    end = at + n * np.dtype(kind).itemsize
                    columns.append(raw[at:end].view(kind))
                    at = end
                self.shards[shard] = key, columns

    def find(self, wanted: np.ndarray) -> list[np.ndarray]:
        """Columns for sorted hashes; 0 where there is none."""
        out = [np.zeros(len(wanted), k) for k in self.kinds]
        cuts = np.searchsorted(wanted >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64)) if self.bits else [0, len(wanted)]
        for shard, (key, columns) in self.shards.items():
            a, b = int(cuts[shard]), int(cuts[shard + 1])
            at = np.minimum(np.searchsorted(key, wanted[a:b]), len(key) - 1)
            there = key[at] == wanted[a:b]
            for x, column in zip(out, columns, strict=True):
                x[a:b] = np.where(there, column[at], 0)
        return out


def _mapped(uri: str) -> np.ndarray | None:
    if urlparse(uri).scheme in ("", "file"):
        path = urlparse(uri).path
        return np.memmap(path, np.uint8, "r") if os.path.exists(path) and os.path.getsize(path) else None
    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with tempfile.TemporaryFile() as local, store.open_input_stream(path) as source:
        while piece := source.read(1 << 22):
            local.write(piece)
        local.flush()
        return np.memmap(local, np.uint8, "r") if local.tell() else None


class Scorer:
    """Scores runs of texts with the mapped arrays of a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        open_ = lambda name, kinds, bits: Arrays(model.folder, name, bits, kinds)
        self.word = open_("word-0", [np.uint64], model.bits)
        self.ngram = {k: open_(f"ngram-{k}", [np.uint8], model.bits) for k in range(1, model.order + 1)}
        self.many = {k: open_(f"many-{k}", [np.uint64], model.bits) for k in range(1, model.order + 1)}
        kinds = [np.uint32, np.uint32, np.uint32, np.uint64]
        self.context = {k: open_(f"context-{k}", kinds, model.bits if k > 1 else 0) for k in range(1, model.order + 1)}

    def probabilities(self, hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and model probability of each token."""
        model = self.model
        back = _contexts(hashes, count, model.order)
        seen = self._each(self.word, hashes)[0].astype(np.int64)
        p = np.full(len(hashes), 1.0 / (model.words + 1))
        for level in range(1, model.order + 1):
            words = back[:level][::-1]
            n = self._counts(level, _spelled(words))
            context = _spelled(words[:-1]) if level > 1 else np.zeros(len(hashes), U64)
            one, two, more, total = (x.astype(float) for x in self._each(self.context[level], context))
            d = np.array([0.0, *model.discounts.get(level, [0.5, 1.0, 1.5])])
            taken = d[np.minimum(n, 3).astype(int)]
            left = d[1] * one + d[2] * two + d[3] * more
            p = np.where(total > 0, (np.maximum(n - taken, 0) + left * p) / np.maximum(total, 1), p)
        return seen, p

    def _counts(self, level: int, ngrams: np.ndarray) -> np.ndarray:
        n = self._each(self.ngram[level], ngrams)[0].astype(float)
        full = n == 255
        n[full] = self._each(self.many[level], ngrams[full])[0]
        return n

    @staticmethod
    def _each(arrays: Arrays, wanted: np.ndarray) -> list[np.ndarray]:
        distinct, back = np.unique(wanted, return_inverse=True)
        return [x[back] for x in arrays.find(distinct)]


_open: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): log10 probabilities of each row's whole text."""
    arrow_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _open:
            _open.clear()
            _open[model.folder] = Scorer(model)
        scorer = _open[model.folder]
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for _, hashes, count in token_runs(batch.column(1)):
                seen, p = scorer.probabilities(hashes, count)
                base = np.log10((seen + ADD) / (model.tokens + ADD * (model.words + 1)))
                first = np.cumsum(count) - count
                added = (np.add.reduceat(x, first) for x in ((seen > 0).astype(np.int64), base, np.log10(p)))
                for column, x in zip(columns, (count, *added), strict=True):
                    column.append(x)
            joined = [pa.array(np.concatenate(x) if x else np.zeros(0)) for x in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *joined], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
