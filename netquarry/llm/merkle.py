"""Merkle manifest of a dataset: a tree of digests for each group of rows, one tree over the groups, a proof for every row.

Rows of a group are leaves in a given order; eight neighbours become one node until one is left. Leaves are dealt out in
aligned blocks of SPAN ** STACK (4096), each of which is one unit of work wherever it runs. In a block the successive authentication
paths come from a fractal traversal: subtrees of HEIGHT levels are stacked, the existing ones give the path of the
present leaf, and the desired ones, which come next, grow by one leaf a step; nothing else is held. The blocks' roots are
the leaves of a tree that is as many times smaller and proved the same way, so paths above the blocks are short distributed
tables, and each block appends its own to all its paths.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .exact_dedup import small
from .lookup import lookup

#: Nodes that become one; levels of a subtree; subtrees that are stacked in a block.
ARITY, HEIGHT, STACK = 8, 2, 2
SPAN = ARITY**HEIGHT
#: Low bits of a row's running number that count rows inside a task. Fixed value of Spark's.
INSIDE = (1 << 33) - 1
PATH = "array<struct<before:binary,after:binary>>"


def node(parts: Iterable[bytes]) -> bytes:
    """Digest of digests, as lower-case hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def levels(n: int) -> int:
    """Levels between n leaves and their root."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Subtree:
    """Nodes of HEIGHT levels from level base up, made from leaves that are added one by one; levels below hold an open run only."""

    def __init__(self, base: int, height: int = HEIGHT):
        self.base, self.top = base, base + height
        self.rows: list[list[bytes]] = [[] for _ in range(self.top + 1)]

    def add(self, new: bytes, level: int = 0) -> None:
        row = self.rows[level]
        row.append(new)
        if level < self.top and len(row) % ARITY == 0:
            self._lift(level, ARITY)

    def _lift(self, level: int, n: int) -> None:
        row = self.rows[level]
        above = node(row[-n:])
        if level < self.base:
            row.clear()
        self.add(above, level + 1)

    def close(self) -> Subtree:
        """Hash the runs that are still open."""
        for level in range(self.top):
            if n := len(self.rows[level]) % ARITY:
                self._lift(level, n)
        return self

    @classmethod
    def of(cls, leaves: Iterable[bytes], base: int, height: int = HEIGHT) -> Subtree:
        out = cls(base, height)
        for leaf in leaves:
            out.add(leaf)
        return out.close()


def root(leaves: Sequence[bytes], height: int) -> bytes:
    """The node height levels above leaves, holding one open run a level."""
    return Subtree.of(leaves, height, 0).rows[height][0]


def paths(leaves: Sequence[bytes], height: int) -> Iterator[list[tuple[list[bytes], list[bytes]]]]:
    """For each leaf of a block, the siblings before and after it at each level, from below."""
    stacked = max(1, -(-height // HEIGHT))
    spans = [SPAN ** (i + 1) for i in range(stacked)]
    existing = [Subtree.of(leaves[: spans[i]], HEIGHT * i) for i in range(stacked)]
    desired = [Subtree(HEIGHT * i) for i in range(stacked - 1)]
    for j in range(len(leaves)):
        for i, growing in enumerate(desired):
            if j and j % spans[i] == 0:
                existing[i], desired[i] = growing.close(), Subtree(HEIGHT * i)
        path = []
        for level in range(height):
            i = level // HEIGHT
            unit = ARITY**level
            at = j % spans[i] // unit
            run, row = at - at % ARITY, existing[i].rows[level]
            path.append((row[run:at], row[at + 1 : run + ARITY]))
        yield path
        for i, growing in enumerate(desired):
            if j + spans[i] < len(leaves):
                growing.add(leaves[j + spans[i]])


def fold(leaf: bytes, path: Iterable[tuple[Sequence[bytes], Sequence[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = node((*before, leaf, *after))
    return leaf


def encoded(value: Column) -> Column:
    """A value's text for a leaf: its UTF-8 bytes after their number, or a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """A row's digest, binary."""
    return F.unhex(F.sha2(F.concat(*(encoded(v) for v in values)), 256))


def group_key(group: Column) -> Column:
    """A group's name as a string that is never null; the null group comes first, the others in order of their bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (_group and others, a saved table) with _i, the row's place in its group by order, and _n, the group's size.

    One range shuffle sorts all groups, so that a group of any size is spread over tasks; the numbers of rows that tasks
    hold of a group then tell where each begins. Rows equal in everything that orders them must be equal altogether.
    """
    ordered = rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(INSIDE))
    placed = scratch.save(ordered.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), "ordered")
    counts = placed.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    of = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.save(counts.select("_group", "_part", (before - F.col("_first")).alias("_base"), F.sum("_rows").over(of).alias("_n")), "starts")
    out = placed.join(small(starts), ["_group", "_part"])
    return out.select(*rows.columns, (F.col("_at") + F.col("_base")).alias("_i"), "_n")


def in_blocks(nodes: DataFrame, stack: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_i") / SPAN**stack).cast("long"))


def _sorted(table: pa.Table, stack: int) -> tuple[pa.Table, list[bytes], int]:
    """A block's rows in order, their digests as hex, and its height."""
    table = table.sort_by("_i")
    return table, [x.hex().encode() for x in table["_digest"].to_pylist()], min(levels(table["_n"][0].as_py()), HEIGHT * stack)


def parents(nodes: DataFrame, stack: int) -> DataFrame:
    """The roots of blocks of nodes (_group, _i, _n, _digest), as nodes of a smaller tree."""

    def run(table: pa.Table) -> pa.Table:
        table, hashes, height = _sorted(table, stack)
        n = -(-table["_n"][0].as_py() // SPAN**stack)
        above = bytes.fromhex(root(hashes, height).decode())
        return pa.table({"_group": [table["_group"][0].as_py()], "_i": [table["_block"][0].as_py()], "_n": [n], "_digest": pa.array([above], pa.binary())})

    slim = in_blocks(nodes.select("_group", "_i", "_n", "_digest"), stack)
    return slim.groupBy("_group", "_block").applyInArrow(run, "_group string, _i long, _n long, _digest binary")


def upper(nodes: DataFrame, stack: int) -> DataFrame:
    """_group, _i, _path and _root of nodes, a saved table: siblings at each level up to the root of the group.

    Each call leaves a table as many times smaller as a block has nodes, until groups have one node, whose path is empty.
    """
    if nodes.filter("_n > 1").isEmpty():
        return nodes.select("_group", "_i", F.array().cast(PATH).alias("_path"), F.col("_digest").alias("_root"))
    higher = upper(scratch.save(parents(nodes, stack), "nodes"), stack)

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, hashes, height = _sorted(table, stack)
        rest = above["_path"][0].as_py()
        joined = [[{"before": b"".join(b), "after": b"".join(a)} for b, a in path] + rest for path in paths(hashes, height)]
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        tops = pa.array(above["_root"].to_pylist() * len(table), pa.binary())
        return pa.table({"_group": table["_group"], "_i": table["_i"], "_path": pa.array(joined, kind), "_root": tops})

    below = in_blocks(nodes.select("_group", "_i", "_n", "_digest"), stack).groupBy("_group", "_block")
    above = higher.withColumnRenamed("_i", "_block").groupBy("_group", "_block")
    return scratch.save(below.cogroup(above).applyInArrow(run, f"_group string, _i long, _path {PATH}, _root binary"), "upper")


def proofs(
    rows: DataFrame,
    group: Column,
    digest: Column,
    order: str,
    other: Column | None = None,
    siblings: bool = False,
    stack: int = STACK,
) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root and verified of every row; with siblings also them, level by level.

    group: what has a tree of its own, null one of its own that comes first. digest: the row's, binary. other: a digest to
    check in its place, null where it is the row's. The subroots of all groups, in order of the groups' bytes, have the
    tree of the root. Rows of a group come by order (a long column, nulls first) and then by digest, so repeated rows are
    leaves of their own. proof_sha256 is the digest of all siblings from below, left to right; folded_root is computed
    from the checked digest and the siblings, and verified tells whether it is the root. stack: subtrees stacked in a block.
    An empty table gives no row.
    """
    spark = rows.sparkSession
    shape = f"{order} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    shape += ", siblings array<array<string>>" if siblings else ""
    other = F.lit(None).cast("binary") if other is None else other
    slim = rows.select(group_key(group).alias("_group"), F.col(order).cast("long").alias("_key"), digest.alias("_digest"), other.alias("_other"))
    slim = scratch.save(slim, "leaves")
    if slim.isEmpty():
        return spark.createDataFrame([], shape)
    leaves = scratch.save(numbered(slim, "_key", "_digest"), "numbered")
    in_group = upper(scratch.save(parents(leaves, stack), "nodes"), stack)
    # The subroots as leaves of the tree above the groups.
    tops = scratch.save(in_group.filter("_i = 0").select(F.lit("").alias("_group"), F.col("_group").alias("_name"), F.col("_root").alias("_digest")), "subroots")
    tops = scratch.save(numbered(tops, "_name", "_digest"), "numbered-subroots")
    over = upper(scratch.save(parents(tops, stack), "nodes"), stack)

    def climb(table: pa.Table, above: pa.Table) -> pa.Table:
        table, hashes, height = _sorted(table, stack)
        rest, top = above["_path"][0].as_py(), above["_root"].to_pylist()
        joined = [[{"before": b"".join(b), "after": b"".join(a)} for b, a in path] + rest for path in paths(hashes, height)]
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        return pa.table({"_name": table["_name"], "_over": pa.array(joined, kind), "_top": pa.array(top * len(table), pa.binary())})

    named = in_blocks(tops, stack).groupBy("_group", "_block").cogroup(over.withColumnRenamed("_i", "_block").groupBy("_group", "_block"))
    named = named.applyInArrow(climb, f"_name string, _over {PATH}, _top binary")
    weights = in_group.groupBy(F.col("_group").alias("_name")).agg(F.count(F.lit(1)).alias("_weight"))
    named = scratch.save(named.join(weights, "_name").withColumnRenamed("_name", "_group"), "groups")
    # Each block's path to the root: a row for all leaves of a block.
    blocks = lookup(in_group, named, "_group", "_weight")
    blocks = blocks.select("_group", F.col("_i").alias("_block"), F.concat("_path", "_over").alias("_path"), F.col("_root").alias("_sub"), "_top")

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, hashes, height = _sorted(table, stack)
        rest = [(x["before"], x["after"]) for x in above["_path"][0].as_py()]
        tail = b"".join(b + a for b, a in rest)
        rest = [((b,), (a,)) for b, a in rest]
        sub, top = above["_sub"][0].as_py().hex(), above["_top"][0].as_py().hex()
        proved, folded, listed = [], [], []
        for own, changed, path in zip(hashes, table["_other"].to_pylist(), paths(hashes, height), strict=True):
            proved.append(sha256(b"".join(x for b, a in path for x in (*b, *a)) + tail).hexdigest())
            folded.append(fold(changed.hex().encode() if changed is not None else own, (*path, *rest)).decode())
            if siblings:
                every = [b"".join((*b, *a)).decode() for b, a in (*path, *rest)]
                listed.append([[x[k : k + 64] for k in range(0, len(x), 64)] for x in every])
        n = len(table)
        out = {order: table["_key"], "leaf": [h.decode() for h in hashes], "subroot": [sub] * n, "root": [top] * n}
        out |= {"proof_sha256": proved, "folded_root": folded, "verified": [x == top for x in folded]}
        return pa.table(out | ({"siblings": pa.array(listed, pa.list_(pa.list_(pa.string())))} if siblings else {}))

    work = in_blocks(leaves, stack).groupBy("_group", "_block").cogroup(blocks.groupBy("_group", "_block"))
    return work.applyInArrow(run, shape)
