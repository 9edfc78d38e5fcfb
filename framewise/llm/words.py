"""Words of many texts at once: boundaries and 64-bit hashes by array operations over an Arrow batch.

A word's hash depends on its bytes alone (A-Z lower-cased). Texts are taken in runs of about ``RUN_BYTES``; a longer
text makes a run of its own, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but the six white-space bytes.
NOT_SPACE = ~_SPACE
#: Letters, digits and all bytes of non-ASCII characters; the classes are over lower-cased bytes.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_random = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = int(_random.integers(0, 1 << 62)) * 8 + 5
_BACK = pow(_BASE, -1, 1 << 64)
_WORD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word; one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as any run has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BACK)):
                x = np.full(n, base, U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))


_powers = _Powers()


@dataclass
class Run:
    """Words of rows ``first`` to ``first + rows``: byte ranges in ``data``, row of each word, hash, words per row."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``limit`` bytes together, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_runs(
    column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = True, cuts: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[Run]:
    """The words of a string column, run by run, in order; every row belongs to one run. Without ``lower`` case counts.
    ``cuts`` marks the bytes at which a word also begins beside another one."""
    data, offsets = text_buffer(column)
    for first, last in row_runs(offsets):
        own = offsets[first : last + 1] - offsets[first]
        raw = data[offsets[first] : offsets[last]]
        yield _words(first, _LOWER[raw] if lower else raw, own, kind, cuts)


def _words(first: int, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, cuts: Callable | None = None) -> Run:
    n, rows = len(data), len(offsets) - 1
    inside = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    begins, ends = inside & ~before[:n], inside & ~after[1:]
    if cuts is not None:
        more = cuts(data) & inside & before[:n]
        begins |= more
        ends[:-1] |= more[1:]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    _powers.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * _powers.up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * _powers.down[start])
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    return Run(first, rows, data, offsets, start, end, row, hashes, count)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, without regard to rows; empty when there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = np.zeros(n, U64)
    for j in range(size):
        x = (x ^ hashes[j : j + n]) * _WORD
        x ^= x >> U64(29)
    return mix(x)
