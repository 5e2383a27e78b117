"""The trie of conversation prefixes by a splitter skeleton.

A conversation is a path: one 128-bit hash of role and text per turn.  Paths are sorted by
range into shards, equal paths by their conversation ids, so a large group of copies is
spread like all others.  A node of the trie is a run of neighbouring paths.  A run that
reaches over the border of two shards is a prefix of the path at that border, so the trie
of the border paths, the skeleton, holds every node that more than one shard has a part
of.  It is broadcast (shards x depth at most, and cut where both sides of a border part);
each shard streams over its sorted paths with a stack of open nodes, finishes all others
on its own and sends one partial aggregate per skeleton node, which a grouping adds up.

Subtree sums stay linear: a node counts as child and leaf in the last shard that has a
part of it, and the ``- 1`` in ``n_convs - 1`` is taken off skeleton nodes from the
skeleton alone.  Ids that end at a skeleton node are sent on as ordered pieces of text and
hashed in a stream, so a group of any size passes through without being held.

Defined cases: turns are ordered by their number, null first, then by their hash; a null
role or text is empty; rows without a conversation id belong to no conversation; repeated
rows are repeated turns; a conversation that is left with no turn is a member of the root
only; an empty table has no nodes; texts of any length enter as their hash and length;
other columns are ignored.  One conversation's hashes (32 bytes a turn) are one value in a
row, its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from skemata.llm.common import written

# Hexadecimal digits of a turn's hash.
STEP = 32
# Ids of one skeleton node that are sent on together, in characters.
PIECE = 1 << 20
HEADS = 5
LOCAL, PARTIAL, ENDS = 0, 1, 2


def conversation_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, turns``: hash and length in code points of every turn, in order.  Rows
    meet by their hundred (``base``), so what follows needs no other shuffle."""
    role_, text_ = (F.coalesce(rows[f"`{c}`"], F.lit("")) for c in (role, text))
    number = rows[f"`{turn}`"]
    one = F.struct(
        number.isNotNull().alias("numbered"),
        number.alias("number"),
        F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)).alias("key"),
        F.length(text_).alias("size"),
    )
    id_ = rows[f"`{conv_id}`"].cast("long")
    turns = rows.select(id_.alias("conv_id"), (id_ - id_ % 100).alias("base"), one.alias("turn"))
    return (
        turns.filter("conv_id is not null")
        .repartition("base")
        .groupBy("base", "conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: every conversation with its first turns taken from the
    first conversation of its hundred, as many as a hash of its id says (0 to 5)."""
    own = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS))
    head = F.coalesce(F.max(own).over(Window.partitionBy("base")), F.slice("turns", 1, 0))
    n = (F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)).cast("int")
    rest = F.slice("turns", n + 1, F.size("turns"))
    whole = turns.select("conv_id", F.concat(F.slice(head, F.lit(1), n), rest).alias("turns"))
    return whole.select("conv_id", *path_columns(F.col("turns")))


def path_columns(turns: Column) -> list[Column]:
    return [F.array_join(turns["key"], "").alias("path"), turns["size"].alias("sizes")]


class Border(NamedTuple):
    """What two neighbouring shards share: the common path of their border rows."""

    path: str
    sizes: list[int]


class Skeleton:
    """The trie of the border paths; node 0 is the root."""

    def __init__(self, shards: list[int], borders: list[Border]):
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.depth, self.size = [-1], [0], [0]
        # how deep the last path of each shard goes on in the next shard; -1: nowhere
        depths = [len(b.sizes) for b in borders] + [-1]
        self.shared = dict(zip(shards, depths, strict=False))
        for border in borders:
            node = 0
            for d, size in enumerate(border.sizes):
                step = node, border.path[d * STEP : (d + 1) * STEP]
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(d + 1)
                    self.size.append(size)
                node = self.child[step]
        # of a node and all skeleton nodes below it; a child's number is above its parent's
        self.below = list(self.size)
        for node in range(len(self.parent) - 1, 0, -1):
            self.below[self.parent[node]] += self.below[node]


def common_steps(a: str, b: str) -> int:
    """Turns that two paths begin with alike."""
    most = min(len(a), len(b)) // STEP
    low = 0
    while low < most and a[low * STEP : (low + 1) * STEP] == b[low * STEP : (low + 1) * STEP]:
        low += 1
    return low


class Node:
    """An open node of the stack."""

    __slots__ = ("before", "children", "conv", "ends", "leaves", "n", "parted", "saved", "seen", "size", "skeleton")

    def __init__(self, skeleton: int, before: int, size: int):
        self.skeleton, self.before, self.size = skeleton, before, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.seen = False  # a child, in this shard
        self.ends = None  # a running hash, or the ids not yet sent on
        self.parted = 0  # pieces sent on


NODES = (
    "kind int, shard int, place long, depth int, skeleton int, conv_id long, n long, "
    "children long, leaves long, saved long, ends string"
)
NAMES = [field.split()[0] for field in NODES.split(", ")]


class Shard:
    """Streams over one shard's sorted paths and yields rows of ``NODES``."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton = shard, skeleton
        self.path, self.opened = "", 1
        self.stack = [Node(0, 0, 0)]
        self.rows: list[tuple] = []

    def add(self, conv: int, path: str, sizes: list[int]) -> None:
        common = common_steps(self.path, path)
        while len(self.stack) - 1 > common:
            self.close(True)
        for d in range(common, len(sizes)):
            top = self.stack[-1]
            top.seen = True
            id_ = -1
            if top.skeleton >= 0:
                id_ = self.skeleton.child.get((top.skeleton, path[d * STEP : (d + 1) * STEP]), -1)
            self.stack.append(Node(id_, self.opened, sizes[d]))
            self.opened += 1
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(conv, node.conv)
        if node.skeleton < 0:
            if node.ends is None:
                node.ends = hashlib.sha256(str(conv).encode())
            else:
                node.ends.update(f",{conv}".encode())
        else:
            node.ends = f"{node.ends},{conv}" if node.ends else str(conv)
            if len(node.ends) >= PIECE:
                self.part(node)

    def part(self, node: Node) -> None:
        self.rows.append((ENDS, self.shard, node.parted, 0, node.skeleton, *[None] * 5, node.ends))
        node.ends, node.parted = None, node.parted + 1

    def close(self, whole: bool) -> None:
        """Ends the top node; ``whole`` tells that no later shard has a part of it."""
        node, depth = self.stack.pop(), len(self.stack)
        node.leaves += whole and not node.seen
        local = node.skeleton < 0
        node.saved += (node.n - local) * node.size
        if self.stack:
            top = self.stack[-1]
            top.n += node.n
            top.conv = node.conv if top.conv is None else min(top.conv, node.conv)
            top.leaves += node.leaves
            top.saved += node.saved
            top.children += whole
        if not local and node.ends:
            self.part(node)
        sums = (node.conv, node.n, node.children, node.leaves, node.saved)
        if local:
            above = self.stack[-1].skeleton
            ends = node.ends.hexdigest() if node.ends else None
            self.rows.append((LOCAL, self.shard, node.before, depth, above, *sums, ends))
        else:
            self.rows.append((PARTIAL, self.shard, 0, depth, node.skeleton, *sums, None))

    def finish(self) -> None:
        shared = self.skeleton.shared[self.shard]
        while self.stack:
            self.close(len(self.stack) - 1 > shared)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 5 + [pa.string()]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES
    )


def borders_of(placed: DataFrame) -> tuple[list[int], list[Border]]:
    """The shards that have rows, and what each of them shares with the next; as many rows
    as shards reach the driver."""
    row = F.struct("path", "sizes")
    ends = placed.groupBy("shard").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    found = sorted(ends.collect(), key=lambda r: r.shard)
    borders = []
    for one, other in zip(found[:-1], found[1:], strict=True):
        n = common_steps(one.high.path, other.low.path)
        borders.append(Border(other.low.path[: n * STEP], other.low.sizes[:n]))
    return [r.shard for r in found], borders


def shard_nodes(placed: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The finished nodes of all shards and their parts of skeleton nodes."""
    shared = placed.sparkSession.sparkContext.broadcast(skeleton)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for at, path, conv, sizes in zip(*columns, strict=True):
                if shard is None or shard.shard != at:
                    if shard is not None:
                        shard.finish()
                        yield as_batch(shard.rows)
                    shard = Shard(at, shared.value)
                shard.add(conv, path, sizes)
                if len(shard.rows) >= 5000:
                    yield as_batch(shard.rows)
                    shard.rows.clear()
        if shard is not None:
            shard.finish()
            yield as_batch(shard.rows)

    ordered = placed.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    return ordered.select("shard", "path", "conv_id", "sizes").mapInArrow(rows, NODES)


def streamed_hashes(pieces: DataFrame) -> DataFrame:
    """``skeleton, ends``: one hash over the pieces of each node, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.int32()), pa.array([running.hexdigest()])], names=["skeleton", "ends"]
            )

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at == node:
                    running.update(b"," + text.encode())
                else:
                    if node is not None:
                        yield row()
                    node, running = at, hashlib.sha256(text.encode())
        if node is not None:
            yield row()

    ordered = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "place")
    return ordered.select("skeleton", "ends").mapInArrow(rows, "skeleton int, ends string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Finished nodes with their parent's smallest member, where the parent is of the same
    shard: in the order in which they were opened, the parent is the last node above."""
    schema = StructType(nodes.schema.fields).add("parent_conv_id", LongType())
    names = schema.names
    at = {n: i for i, n in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: list[int] = []
        for batch in batches:
            depths, skeleton, convs = (
                batch.column(at[n]).to_pylist() for n in ("depth", "skeleton", "conv_id")
            )
            parents = []
            for depth, top, conv in zip(depths, skeleton, convs, strict=True):
                if len(above) < depth + 1:
                    above.extend([0] * (depth + 1 - len(above)))
                above[depth] = conv
                parents.append(above[depth - 1] if top < 0 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, pa.int64())], names=names)

    return nodes.repartition("shard").sortWithinPartitions("shard", "place").mapInArrow(rows, schema)


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``paths`` (``conv_id, path, sizes``)."""
    spark = paths.sparkSession
    if shards is None:
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        paths.repartitionByRange(shards, "path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .withColumn("shard", F.spark_partition_id()),
        "paths",
    )
    skeleton = Skeleton(*borders_of(placed))
    nodes = written(shard_nodes(placed, skeleton), "nodes")

    fixed = spark.createDataFrame(
        list(zip(range(len(skeleton.parent)), skeleton.parent, skeleton.depth, skeleton.below, strict=True)),
        "skeleton int, parent int, depth int, below long",
    )
    partial = nodes.filter(F.col("kind") == PARTIAL).groupBy("skeleton")
    sums = partial.agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    )
    ends = streamed_hashes(nodes.filter(F.col("kind") == ENDS))
    shared = written(
        sums.join(fixed, "skeleton")
        .join(ends, "skeleton", "left")
        .withColumn("saved", F.col("saved") - F.col("below")),
        "skeleton", len(skeleton.parent),
    )
    # as many rows as the skeleton has nodes, broadcast like the skeleton
    tops = shared.select(F.col("skeleton").alias("top"), F.col("conv_id").alias("top_conv_id"))
    tops = F.broadcast(tops)

    local = with_parents(nodes.filter(F.col("kind") == LOCAL))
    local = local.join(tops, local["skeleton"] == tops["top"], "left").withColumn(
        "parent_conv_id", F.coalesce("top_conv_id", "parent_conv_id")
    )
    upper = shared.join(tops, shared["parent"] == tops["top"], "left").withColumn(
        "parent_conv_id", F.col("top_conv_id")
    )
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(empty)).alias("ends_sha256"),
    ]
    return local.select(*columns).unionByName(upper.select(*columns))


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    return trie(rebuilt(conversation_turns(conversations)), shards)
