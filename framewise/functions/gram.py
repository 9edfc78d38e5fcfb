"""Pearson correlations of many column pairs from one reading of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import ref

#: Columns on a side of one block of pairs: a task's sums then take 48 MB.
BLOCK = 1_000
ROWS = 2_048
#: A spread below this share of the squared distances from the shift is rounding, and counts as none.
ROUNDING = 1e-12

_MOMENTS = ("n", "ma", "mb", "va", "vb", "c")


class PairSums:
    """Sums over the rows where both columns of a pair have a value, for all pairs of two lists of columns.

    Values are shifted by one of the column's own first values, its middle one, so the sums of squares stay exact for a
    constant column and lose little otherwise. Products of value and presence matrices give all pairs at once.
    """

    def __init__(self) -> None:
        self.shift: np.ndarray | None = None

    def add(self, values: np.ndarray, left: int) -> None:
        """``values`` has a column for each name on the left, then on the right; missing values are masked arrays' holes."""
        there = ~np.ma.getmaskarray(values)
        data = values.filled(0.0)
        odd = there & ~np.isfinite(data)
        data[odd] = 0.0
        if self.shift is None:
            seen = np.sort(np.where(there, data, np.inf), axis=0)
            middle = np.maximum((there.sum(axis=0) - 1) // 2, 0)
            first = seen[middle, np.arange(data.shape[1])]
            self.shift = np.where(np.isfinite(first), first, 0.0)
            self.sums = [np.zeros((left, data.shape[1] - left)) for _ in range(7)]
        x = np.where(there, data - self.shift, 0.0)
        m = there.astype(float)
        (a, b), (ma, mb) = (np.split(z, [left], axis=1) for z in (x, m))
        parts = [ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b]
        if odd.any():
            oa, ob = np.split(odd.astype(float), [left], axis=1)
            parts.append(oa.T @ mb + ma.T @ ob)
        for total, part in zip(self.sums, parts, strict=False):
            total += part

    def moments(self, left: int) -> tuple[np.ndarray, ...]:
        """Count, means, sums of squared distances from them, and of their products; NaN where a pair met no finite value."""
        n, sa, sb, qa, qb, p, odd = self.sums
        some = np.maximum(n, 1)
        va, vb = qa - sa * sa / some, qb - sb * sb / some
        va[va <= ROUNDING * qa], vb[vb <= ROUNDING * qb] = 0.0, 0.0
        c = p - sa * sb / some
        c[odd > 0] = np.nan
        return n, sa / some + self.shift[:left, None], sb / some + self.shift[None, left:], va, vb, c


def merged(one: Sequence[np.ndarray], two: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Moments of two sets of rows together."""
    (n, ma, mb, va, vb, c), (k, na, nb, wa, wb, d) = one, two
    total = n + k
    some = np.maximum(total, 1)
    da, db, share = na - ma, nb - mb, n * k / some
    return total, ma + da * k / some, mb + db * k / some, va + wa + da * da * share, vb + wb + db * db * share, c + d + da * db * share


def pair_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(i, j, pairs, r) for each column ``left[i]`` and ``right[j]``: complete rows and Pearson r, null where a side
    does not vary over them, NaN where they hold a value that is not finite.

    Tasks hand on one row of moments per left column; rows of the same column are merged in another exchange. Lists longer than
    ``BLOCK`` are taken in blocks, each of which reads its own columns only.
    """
    parts = [_block(df, left, right, a, b) for a in range(0, len(left), BLOCK) for b in range(0, len(right), BLOCK)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _block(df: DataFrame, left: Sequence[str], right: Sequence[str], a: int, b: int) -> DataFrame:
    first, second = left[a : a + BLOCK], right[b : b + BLOCK]
    size = len(first)
    names = list(dict.fromkeys([*first, *second]))
    place = {c: k for k, c in enumerate(names)}
    order = [place[c] for c in (*first, *second)]
    rows = df.select(*[ref(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    schema = "i int, " + ", ".join(f"{m} array<double>" for m in _MOMENTS)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        columns = []
        for column in batch.columns:
            values = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            columns.append(np.ma.masked_array(values, column.is_null().to_numpy(zero_copy_only=False)))
        return np.ma.stack(columns, axis=1)[:, order]

    def listed(i: np.ndarray, moments: Sequence[np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array(list(m), pa.list_(pa.float64())) for m in moments]
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *lists], names=["i", *_MOMENTS])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sums.add(matrix(batch.slice(at, ROWS)), size)
        if sums.shift is not None:
            yield listed(np.arange(size), sums.moments(size))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            moments = [np.stack([np.asarray(x, float) for x in column.to_pylist()]) for column in batch.columns[1:]] if batch.num_rows else []
            for k, i in enumerate(batch.column(0).to_pylist()):
                own = tuple(m[k] for m in moments)
                found[i] = merged(found[i], own) if i in found else own
        for i, (n, _, _, va, vb, c) in found.items():
            with np.errstate(all="ignore"):
                r = c / np.sqrt(va * vb)
            none = ((va == 0) | (vb == 0)) & ~np.isnan(c)
            j = np.arange(len(n), dtype=np.int32)
            columns = [pa.array(np.full(len(n), i, np.int32)), pa.array(j), pa.array(n.astype(np.int64)), pa.array(r, mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "pairs", "r"])

    apart = rows.mapInArrow(summed, schema).repartition("i")
    found = apart.mapInArrow(together, "i int, j int, pairs long, r double")
    return found.select((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), "pairs", "r")
