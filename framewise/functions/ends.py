"""First and last rows of each key in one reading of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import ref

#: Rows gathered before the kept ones are picked again.
PENDING = 50_000


def first_last(df: DataFrame, key: str, order: Sequence[str], n: int, columns: Sequence[str] = ()) -> DataFrame:
    """One row per key: key, ``rows`` (how many it has), ``first`` and ``last``, its first and last n rows in ascending order.

    Each task keeps 2 n rows and a counter per key and hands only these on; one exchange on the key brings them together,
    where they are merged in the same way, batch by batch. A key with most of the table thus costs 2 n rows per task.
    The elements of ``first`` and ``last`` have the order columns and ``columns``. Missing order values come first; a
    missing key is a key of its own.
    """
    given = [key, *order, *columns]
    rows = df.select(*[ref(c) for c in given], F.lit(1).cast("long").alias("_n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def merged(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        by = [(c, "ascending") for c in (key, *order)]
        table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start"))
        code = table.column(key).combine_chunks().dictionary_encode("encode")
        code = pa.chunked_array([code]).combine_chunks().indices.to_numpy()
        start = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
        size = np.diff(np.append(start, len(code)))
        place = np.arange(len(code)) - np.repeat(start, size)
        back = np.repeat(size, size) - 1 - place
        # The first row of a key always stays and carries the key's count.
        count = np.zeros(len(code), np.int64)
        count[start] = np.add.reduceat(table.column("_n").to_numpy(), start)
        # The field as given, so that kept rows and new batches have one schema.
        at = table.schema.get_field_index("_n")
        table = table.set_column(at, table.schema.field(at), pa.array(count))
        keep = (place < n) | (back < n)
        return table.filter(pa.array(keep)), place[keep] < n, back[keep] < n

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        size = base = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= max(PENDING, 2 * base):
                    held = merged(pa.Table.from_batches(held))[0].to_batches()
                    size = base = sum(b.num_rows for b in held)
        if held:
            yield merged(pa.Table.from_batches(held))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _ in kept(batches):
            yield from table.to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, last in kept(batches):
            table = table.append_column("_first", pa.array(first)).append_column("_last", pa.array(last))
            yield from table.to_batches()

    apart = rows.mapInArrow(partial, schema).repartition(ref(key))
    whole = apart.mapInArrow(final, f"{schema}, _first boolean, _last boolean")
    row = F.struct(*[ref(c) for c in (*order, *columns)])
    pick = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), row)))
    # At most 2 n rows of a key are left.
    return whole.groupBy(ref(key)).agg(F.sum("_n").alias("rows"), pick("_first").alias("first"), pick("_last").alias("last"))
