"""Merkle manifest of a dataset: leaves per source, subroots, one root, inclusion proofs and their check.

H is the lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A leaf is H of doc_id, source, lang,
n_chars and text, each ``-`` when null, else its UTF-8 byte count, ``:`` and the value. Leaves of a source ascend by
doc_id (null first, equal ones by leaf); every ``ARITY`` consecutive nodes of a level (the last run may be shorter, even
one node) become their H until one node remains, the source's subroot. Subroots in the order of their sources (null
first, then UTF-8 bytewise) make the root in the same way.

Positions come from one range exchange and counts per (partition, source). ``ARITY ** depth`` consecutive nodes are a
superblock, the unit of all further work, so a hot source is many groups of bounded size. Going up, each superblock is reduced to
one node, and the nodes so made are leaves of the next pass; sources are a table like any other and may be many.
Going down, a pass cogroups nodes with the outer nodes their superblock needs (siblings up to the root) in
``applyInPandas``: it redoes the local reduction, joins inner and outer siblings to whole proofs, and on the last pass
folds the leaf under test with its proof. Every level's tables are stored, so a lost executor costs one task.

Defined cases: repeated rows are leaves of their own; a null doc_id sorts first and is never tampered with; a source's
lone leaf is its subroot, a lone subroot the root; a row whose proof has no siblings has the H of no input; an empty
table gives no rows. Columns beyond the five, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.storage import shared_folder, stored

ARITY = 3
#: Levels of a superblock: 2,187 nodes.
DEPTH = 7
#: Offsets, one per partition and key, that may be broadcast.
BROADCAST_RUNS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "left array<string>, right array<string>"


def _h(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """H of a row's five fields, with some replaced."""
    parts = []
    for name in FIELDS:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def reduce_levels(nodes: list[str], count: int, depth: int) -> list[list[str]]:
    """Levels of a superblock from its nodes up. One node ends it where its key's ``count`` nodes are all in it; beside
    others it takes all ``depth`` steps."""
    levels, alone = [nodes], count <= ARITY**depth
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        below = levels[-1]
        levels.append([_h("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """For each level below the top: the run's nodes before and after the one above ``place``."""
    left, right = [], []
    for level in levels[:-1]:
        first = place - place % ARITY
        left.append("".join(level[first:place]))
        right.append("".join(level[place + 1 : first + ARITY]))
        place //= ARITY
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in zip(left, right, strict=True):
        node = _h(before + node + after)
    return node


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """One node for each superblock of (key, n, pos, digest)."""
    span = ARITY**depth

    def top(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        n, pos = int(frame["n"].iloc[0]), int(frame["pos"].iloc[0])
        levels = reduce_levels(frame["digest"].tolist(), n, depth)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "n": [-(-n // span)], "pos": [pos // span], "digest": [levels[-1][0]]})

    block = F.floor(F.col("pos") / ARITY**depth)
    return nodes.select("key", "n", "pos", "digest").groupBy("key", block).applyInPandas(top, "key string, n long, pos long, digest string")


def _exchange(nodes: DataFrame, outer: DataFrame, finish: Callable[[pd.DataFrame, list, list], pd.DataFrame], schema: str, depth: int) -> DataFrame:
    """Cogroup nodes with the outer siblings of their superblock; ``finish`` gets the sorted nodes and their whole proofs."""

    def join(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        levels = reduce_levels(frame["digest"].tolist(), int(frame["n"].iloc[0]), depth)
        up_left, up_right = list(above["left"].iloc[0]), list(above["right"].iloc[0])
        proofs = [siblings(levels, i) for i in range(len(frame))]
        left, right = [p[0] + up_left for p in proofs], [p[1] + up_right for p in proofs]
        return finish(frame.assign(subroot=above["subroot"].iloc[0], root=above["root"].iloc[0]), left, right)

    block = F.floor(F.col("pos") / ARITY**depth)
    return nodes.groupBy("key", block).cogroup(outer.groupBy("key", "pos")).applyInPandas(join, schema)


def _paths(frame: pd.DataFrame, left: list, right: list) -> pd.DataFrame:
    return frame[["key", "pos", "subroot", "root"]].assign(left=left, right=right)


_PATHS = f"key string, pos long, subroot string, root string, {_PROOF}"


def _pyramid(nodes: DataFrame, folder: str, depth: int) -> list[DataFrame]:
    """The nodes and the tables of superblock nodes above them, the last with one node for each key."""
    levels = [nodes]
    while len(levels) == 1 or (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(stored(_tops(levels[-1], depth), folder))
    return levels


def _descend(levels: list[DataFrame], outer: DataFrame, folder: str, depth: int) -> DataFrame:
    """Proofs of the superblock nodes right above the first level, from those of the last."""
    for nodes in reversed(levels[1:-1]):
        outer = stored(_exchange(nodes, outer, _paths, _PATHS, depth), folder)
    return outer


def positions(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Add ``pos``, the place among the rows of the same ``key``, and ``n``, their number.

    One range exchange over (key, order, row) sorts everything; a row's place is its slot in its partition's part of the
    key plus the key's rows in earlier partitions. Rows alike in all columns are still told apart by their number.
    """
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), folder)
    by = ["key", *order, "_row"]
    placed = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    slot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.select("*", F.spark_partition_id().alias("_part"), slot.alias("_slot")), folder)
    runs = placed.groupBy("key", "_part").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_count"))
    # Each key has one row for each partition that it reaches, which bounds the window's groups.
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")
    runs = runs.select("key", "_part", offset.alias("_offset"), F.sum("_count").over(Window.partitionBy("key")).alias("n"))
    runs = stored(runs, folder)
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    return placed.join(runs, ["key", "_part"]).withColumn("pos", F.col("_slot") + F.col("_offset")).drop("_part", "_slot", "_offset")


def manifest(docs: DataFrame, received: dict[str, Column] | None = None, proofs: bool = False, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``proofs`` the
    siblings themselves (left, right: by level, those before and after the node).

    ``received`` gives fields as they arrived; the leaf of the row so changed is folded with the original siblings.
    """
    folder = shared_folder(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    leaf = leaf_digest()
    read = leaf_digest(received) if received else leaf
    rows = docs.select(key.alias("key"), "doc_id", leaf.alias("leaf"), read.alias("received"))
    placed = positions(rows, ["doc_id", "leaf"], folder)
    id_ = F.col("doc_id").cast("string").alias("id")
    leaves = stored(placed.select("key", "n", "pos", F.col("leaf").alias("digest"), "received", id_), folder)
    up = _pyramid(leaves, folder, depth)

    # The sources in their order are the nodes of one more tree.
    sources = up[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "digest")
    sources = stored(positions(sources, ["source"], folder), folder)
    top = _pyramid(sources, folder, depth)
    none = F.array().cast("array<string>")
    root = top[-1].select("key", "pos", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("left"), none.alias("right"))
    outer = _exchange(sources, _descend(top, root, folder, depth), _sources, f"source string, digest string, root string, {_PROOF}", depth)
    outer = outer.select(F.col("source").alias("key"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "left", "right")
    outer = _descend(up, stored(outer, folder), folder, depth)

    def finish(frame: pd.DataFrame, left: list, right: list) -> pd.DataFrame:
        whole = [_h("".join(x + y for x, y in zip(a, b, strict=True))) for a, b in zip(left, right, strict=True)]
        folded = [fold(*x) for x in zip(frame["received"], left, right, strict=True)]
        out = frame[["id", "subroot", "root"]].assign(leaf=frame["digest"], proof_sha256=whole, folded_root=folded)
        return out.assign(left=left, right=right) if proofs else out

    schema = "id string, subroot string, root string, leaf string, proof_sha256 string, folded_root string"
    done = _exchange(leaves, outer, finish, f"{schema}, {_PROOF}" if proofs else schema, depth)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return done.select(F.col("id").cast(kind).alias("doc_id"), *names, verified, *(["left", "right"] if proofs else []))


def _sources(frame: pd.DataFrame, left: list, right: list) -> pd.DataFrame:
    return frame[["source", "digest", "root"]].assign(left=left, right=right)
