"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. The automaton holds every sequence of
words of every item. A document's words stream through it, which tracks the longest item sequence that ends at each
word; where that reaches ``window`` words, those last words are an occurrence of a window. An item of fewer words is
one window as a whole, found by the automaton's suffix links.

Only stretches whose every neighbouring pair of words is a pair of some item go through the automaton, as no
window can lie elsewhere. Items are split by a hash of their text into shards of about ``SHARD_BYTES``; each shard's
automaton is broadcast to the tasks, and documents pass the shards one after another without a shuffle.

Defined cases: null and empty texts and items have no words; repeated items count once for each distinct item_id;
an item without item_id marks words but is not named; documents that repeat, or lack a doc_id, are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.storage import arrow_batches, mapped, shared_folder, stored
from framewise.llm.words import ALNUM, U64, word_runs

WINDOW = 13
SHARD_BYTES = 8 * 1024 * 1024
#: A document is contaminated when at least one word in so many is hit.
COVERAGE = 20

_SPAN = "struct<first:long,last:long,start:long,end:long>"


class ItemAutomaton:
    """Suffix automaton of word sequences. ``owners`` maps the state of each window to the items that have it."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
        self.window = window
        self.owners: dict[int, set[int]] = {}
        self.whole: dict[int, dict[int, set[int]]] = {}
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: The state of the last ``window`` words, for states that are so long.
        self.tail = [-1] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.tail[v] = v if self.length[up] < window else self.tail[up]
        for item, words in items:
            self._mark(item, words)
        #: The nearest state up the suffix links, itself included, that ends a whole short item.
        self.short = [-1] * len(self.link)
        for v in order:
            self.short[v] = v if v in self.whole else self.short[self.link[v]]

    def _extend(self, last: int, word: int) -> int:
        to = self.next[last].get(word)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new = self._add({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: int, to: int) -> int:
        copy = self._add(dict(self.next[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _mark(self, item: int, words: list[int]) -> None:
        state = 0
        for place, word in enumerate(words, 1):
            state = self.next[state][word]
            if place >= self.window:
                self.owners.setdefault(self.tail[state], set()).add(item)
        if 0 < len(words) < self.window:
            self.whole.setdefault(state, {}).setdefault(len(words), set()).add(item)

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(first, last + 1, items) of each window occurrence in a stretch of words."""
        state = matched = 0
        for at, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.next[state]:
                continue
            state = self.next[state][word]
            matched += 1
            if matched >= self.window:
                yield at - self.window, at, self.owners[self.tail[state]]
            v = self.short[state]
            while v > 0:
                for size, names in self.whole[v].items():
                    if size <= matched:
                        yield at - size, at, names
                v = self.short[self.link[v]]


@dataclass
class Matcher:
    """The automaton with the vocabulary and the neighbouring pairs of its items; ``names`` has the ids of each text."""

    vocabulary: np.ndarray
    pairs: np.ndarray
    shortest: int
    automaton: ItemAutomaton
    names: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[list[str], str]], window: int) -> Matcher:
        hashed: list[np.ndarray] = []
        for run in word_runs(pa.array([text for _, text in items], pa.string()), ALNUM):
            hashed += np.split(run.hash, np.cumsum(run.count)[:-1])
        everything = np.concatenate([*hashed, np.zeros(0, U64)])
        vocabulary = np.unique(everything)
        ids = [np.searchsorted(vocabulary, h) for h in hashed]
        pairs = np.unique(np.concatenate([x[:-1] * len(vocabulary) + x[1:] for x in ids] or [np.zeros(0, np.int64)]))
        shortest = min([window, *(len(x) for x in ids if len(x))])
        numbered = [(k, x.tolist()) for k, x in enumerate(ids)]
        return cls(vocabulary, pairs, shortest, ItemAutomaton(numbered, window), [sorted(names) for names, _ in items])

    def occurrences(self, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """Window occurrences among the words of several rows, by place in ``hashes``."""
        if not len(self.vocabulary) or not len(hashes):
            return
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        joined = np.zeros(len(ids) + 1, bool)
        close = np.flatnonzero(known[1:] & known[:-1] & (row[1:] == row[:-1]))
        if len(close) and len(self.pairs):
            key = ids[close] * len(self.vocabulary) + ids[close + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[close[self.pairs[at] == key] + 1] = True
        first = np.flatnonzero(known & ~joined[:-1])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        long = last - first >= self.shortest
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            for begin, end, names in self.automaton.stream(ids[a:b].tolist()):
                yield a + begin, a + end, names


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            a = out[-1]
            out[-1] = (a[0], max(a[1], span[1]), a[2], max(a[3], span[3]))
        else:
            out.append(span)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, n_words, spans, items): each row of docs as a struct, its word count, the stretches of hit words as word
    range and byte range, and the ids of the items with occurring windows."""
    spark = docs.sparkSession
    arrow_batches(spark)
    # A text under many ids is one item; a null id names nothing.
    named = items.where(F.col("text").isNotNull()).groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("names"))
    given = stored(named.select("names", "text"), shared_folder(spark))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    out = docs.select(
        F.struct("*").alias("row"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(f"array<{_SPAN}>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for shard in range(shards):
        part = given.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).collect()
        matcher = spark.sparkContext.broadcast(Matcher.of([(r[0], r[1]) for r in part], window))
        out = mapped(out, _matching(matcher), out.schema)
    return out


def _matching(shared):
    """The pass of one shard over the documents."""
    span = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            # flatten() keeps the nulls of the struct and the offset of the batch
            text = batch.column(0).flatten()[batch.column(0).type.get_field_index("text")]
            spans = [[tuple(s.values()) for s in x] for x in batch.column(2).to_pylist()]
            items = [set(x) for x in batch.column(3).to_pylist()]
            hit: dict[int, set[int]] = {}
            counts = []
            for run in word_runs(text, ALNUM):
                counts.append(run.count)
                before = np.cumsum(run.count) - run.count
                touched: dict[int, list] = {}
                for a, b, names in matcher.occurrences(run.hash, run.row):
                    k = int(run.row[a])
                    begin, base = int(run.offsets[k]), int(before[k])
                    touched.setdefault(k, []).append((a - base, b - base, int(run.start[a]) - begin, int(run.end[b - 1]) - begin))
                    hit.setdefault(run.first + k, set()).update(names)
                for k, more in touched.items():
                    spans[run.first + k] = _merged(spans[run.first + k] + more)
            for k, texts in hit.items():
                items[k].update(*[matcher.names[i] for i in texts])
            as_dicts = [[dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in x] for x in spans]
            columns = [
                batch.column(0),
                pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)),
                pa.array(as_dicts, pa.list_(span)),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return match


def words_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def is_contaminated(coverage: int = COVERAGE) -> Column:
    return (words_hit() > 0) & (coverage * words_hit() >= F.col("n_words"))


def leak_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    found = find_leaks(docs.select("doc_id", "text"), items, window)
    return found.select(
        "row.doc_id", "n_words", words_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"), "spans", is_contaminated(coverage).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Documents without contaminated ones (the coverage limit); in the others each hit span, which is as long as a
    window at least (the length limit), is cut out of the text. Columns and all other rows are as before."""
    found = find_leaks(docs, items, window).where(~is_contaminated(coverage))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.column(0).flatten())
            at = batch.column(0).type.get_field_index("text")
            spans = batch.column(1).to_pylist()
            if any(spans):
                new = []
                for text, own in zip(columns[at].to_pylist(), spans, strict=True):
                    if own:
                        raw, pieces, done = text.encode(), [], 0
                        for s in own:
                            pieces.append(raw[done : s["start"]])
                            done = s["end"]
                        text = b"".join([*pieces, raw[done:]]).decode()
                    new.append(text)
                columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(found.select("row", "spans"), cut, docs.schema)
