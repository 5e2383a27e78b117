"""MinHash near-dedup by a chosen-path set similarity join.

Texts with equal shingle sets are one class from the start.  Each class has a
sketch of ``TOKENS`` minwise shingles under independent hash functions.  In each
of ``trees`` independent trees a node branches a class into the children of those
of its tokens whose hash, seeded by the path so far, falls under
1 / (threshold * TOKENS): a pair at the threshold shares one child on average, a
dissimilar pair almost none.  A node of at most ``leaf`` classes is compared
exhaustively on sketches; a larger one branches on, ``depth`` times at most.  Nodes of
more than ``leaf_block`` classes are compared block against block, in several tasks;
classes that are already joined in a task are not compared again.

A node returns a spanning forest of the pairs that may reach the threshold, so its
output is linear in its size.  The forests' components are the groups within which
links are confirmed.  First each class is compared with its smallest neighbour on full
shingle sets, which is linear and joins most of a group; then the members of parts that
are still apart are compared with each other, block against block in matrix products,
and again only a spanning forest of the confirmed links leaves a task.  No pair list
exists anywhere, and no link between classes of one group is lost.

Recall: a pair at the threshold survives one level of a tree with probability
1 - 1/e, two with 0.47, five with 0.28; with 20 trees a pair is missed with
probability 2e-9, 3e-6 and 2e-3, and a pair with more similarity or more links
less often still.  Sketches pass a pair at the threshold but for about 3e-5.

Defined cases: null or empty texts have an empty set, link with nothing and are
kept; fewer words than a shingle are one shingle; equal rows are documents of
their own with one class; a null id is never the smallest of a group; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import in_bitmap, key_bitmap, keyed, without, written
from skemata.llm.components import components
from skemata.llm.wordhash import mix, text_shingles, text_slices, text_words, unique_per_text

TOKENS = 64
# shingles of the full sets in a block, 8 bytes each
BLOCK_VALUES = 2 << 20
# of the bitmap by which texts to be confirmed are picked: 16 MB
MOST_BITS = 27
_RNG = np.random.default_rng(97)
MULTIPLIERS = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
PLACES = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, TOKENS) upper 32 bits of the smallest hash of each non-empty set."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, TOKENS), dtype=np.uint32)
    if len(some):
        starts = offsets[:-1][some]
        with np.errstate(over="ignore"):
            for k in range(TOKENS):
                low = np.minimum.reduceat(values * MULTIPLIERS[k], starts)
                out[some, k] = (low >> np.uint64(32)).astype(np.uint32)
    return out


def chosen(tokens: np.ndarray, paths: np.ndarray, threshold: float):
    """(row, child path): the tokens that each path selects of its row's sketch."""
    limit = np.uint64(int(2.0**64 / (threshold * TOKENS)))
    with np.errstate(over="ignore"):
        named = mix(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + PLACES[None, :])
        drawn = mix(named ^ mix(paths * np.uint64(0xD6E8FEB86659FD93))[:, None])
        rows, places = np.nonzero(drawn < limit)
        children = mix(named[rows, places] + mix(paths[rows] + np.uint64(0xA0761D6478BD642F)))
    return rows, children


def document_sets(docs: DataFrame, text: str, threshold: float, width: int, trees: int):
    """Per row: its keys and id, the set's size and 128-bit name, its sketch and the
    paths of the first level of every tree."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 3, 1 << 20):
            values, offsets = unique_per_text(*text_shingles(*text_words(part.column(3)), width))
            sizes = np.diff(offsets)
            names = [
                xxhash.xxh3_128_digest(values[a:b])
                for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            tokens = sketches(values, offsets)
            who, paths = chosen(
                np.repeat(tokens, trees, axis=0), np.tile(roots, len(tokens)), threshold
            )
            who = who // trees
            full = sizes[who] > 0
            who, paths = who[full], paths[full]
            bounds = np.searchsorted(who, np.arange(len(tokens) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3],
                    pa.array(sizes),
                    pa.array(names, pa.binary()),
                    pa.array([t.tobytes() for t in tokens], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(bounds.astype(np.int32)), pa.array(paths.view(np.int64))
                    ),
                ],
                names=["k1", "k2", "id", "size", "name", "sketch", "paths"],
            )

    return docs.select("__k1", "__k2", "id", F.col(text)).mapInArrow(
        rows,
        "k1 long, k2 long, id long, size long, name binary, sketch binary, paths array<long>",
    )


def _branch(nodes: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(path, name) of the children of large nodes' members."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = np.asarray(batch.column(0)).view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32)
            who, children = chosen(tokens.reshape(-1, TOKENS), paths, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(children.view(np.int64)), batch.column(1).take(pa.array(who))],
                names=["path", "name"],
            )

    members = nodes.join(classes.select("name", "sketch"), "name")
    return members.select("path", "name", "sketch").mapInArrow(rows, "path long, name binary")


def _in_blocks(members: DataFrame, key: str, salt: str, block: int) -> DataFrame:
    """``members`` with a column ``task``: a group of at most ``block`` rows is one task;
    a larger group is dealt into B hashed blocks, and each pair of blocks is a task.

    A row goes to B - 1 tasks, so a task holds two blocks and every pair of rows of a
    group meets in one task at least.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    blocks = F.ceil(F.col("__n") / block)
    mine = F.pmod(F.xxhash64(salt), F.col("__b")).cast("int")
    return (
        members.join(sizes, key)
        .withColumn("__b", blocks.cast("int"))
        .withColumn("__mine", mine)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
        .filter((F.col("__b") == 1) | (F.col("__mine") != F.col("__other")))
        .withColumn(
            "task",
            F.xxhash64(key, F.least("__mine", "__other"), F.greatest("__mine", "__other")),
        )
        .drop("__n", "__b", "__mine", "__other")
    )


class _Forest:
    """Union-find that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[b] = a
                self.edges.append((x, y))


def _sketch_forest(tokens: np.ndarray, sizes: np.ndarray, threshold: float) -> list:
    """Spanning forest of the pairs whose sketches agree often enough, and whose sizes
    allow the threshold at all."""
    spread = 4 * (threshold * (1 - threshold) / TOKENS) ** 0.5
    least = int(np.floor((threshold - spread) * TOKENS))
    label = np.arange(len(tokens))
    trees, edges = len(tokens), []
    for x in range(len(tokens) - 1):
        if trees == 1:
            break
        # rows of the same tree need no comparison, so copies cost one pass
        close = label[x + 1 :] != label[x]
        close &= sizes[x + 1 :] * threshold <= sizes[x] + 1e-9
        close &= sizes[x] * threshold <= sizes[x + 1 :] + 1e-9
        others = np.flatnonzero(close) + x + 1
        if not len(others):
            continue
        others = others[(tokens[others] == tokens[x]).sum(axis=1) >= least]
        if len(others):
            joined, first = np.unique(label[others], return_index=True)
            edges += [(x, y) for y in others[first].tolist()]
            label[np.isin(label, joined)] = label[x]
            trees -= len(joined)
    return edges


def _set_forest(sets: list[np.ndarray], percent: int) -> list:
    """Spanning forest of the pairs with 100 * intersection >= percent * union, exactly.

    Intersections are counts of shared tokens, from products of 0/1 matrices over
    slices of the tokens that occur twice at least (exact in float32 up to 2^24).
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[where] > 1
    column = (np.cumsum(counts > 1) - 1)[where[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), dtype=np.float32)
    step = max(64, (16 << 20) // (4 * n))
    width = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, width, step):
        a, b = np.searchsorted(column, [begin, begin + step])
        matrix = np.zeros((n, min(step, width - begin)), dtype=np.float32)
        matrix[owner[a:b], column[a:b] - begin] = 1
        common += matrix @ matrix.T
    both = np.rint(common).astype(np.int64)
    linked = (both > 0) & (
        100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    )
    forest = _Forest(n)
    for x in range(n - 1):
        forest.join(x, np.flatnonzero(linked[x, x + 1 :]) + x + 1)
    return forest.edges


def _per_task(frame: DataFrame, forest_of) -> DataFrame:
    """Forest edges (a, b) of each task's distinct members; ``frame`` has the columns
    ``task, name, size`` and one of contents."""

    def edges(names: list, sizes: list, contents: list) -> tuple[list, list]:
        distinct: dict[bytes, int] = {}
        for i, name in enumerate(names):
            distinct.setdefault(name, i)
        picked = list(distinct.values())
        if len(picked) < 2:
            return [], []
        found = forest_of([sizes[i] for i in picked], [contents[i] for i in picked])
        return [names[picked[x]] for x, _ in found], [names[picked[y]] for _, y in found]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, ([], [], [])
        out = ([], [])

        def flush():
            for side, more in zip(out, edges(*held), strict=True):
                side.extend(more)
            for h in held:
                h.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = np.asarray(batch.column(0))
            cuts = np.flatnonzero(tasks[1:] != tasks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(tasks)]
            columns = [batch.column(c).to_pylist() for c in (1, 2, 3)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if tasks[a] != task:
                    flush()
                    task = tasks[a]
                for h, c in zip(held, columns, strict=True):
                    h.extend(c[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(side, pa.binary()) for side in out], names=["a", "b"]
            )
            out[0].clear(), out[1].clear()
        flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(side, pa.binary()) for side in out], names=["a", "b"]
        )

    placed = frame.repartition("task").sortWithinPartitions("task")
    return placed.mapInArrow(rows, "a binary, b binary")


def candidate_edges(
    classes: DataFrame, paths: DataFrame, threshold: float, leaf: int, depth: int, block: int
) -> DataFrame:
    """Forest edges over the leaves of all trees."""
    leaves = None
    for level in range(1, depth + 1):
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        nodes = written(paths.join(sizes, "path"), "nodes")
        done = nodes if level == depth else nodes.filter(F.col("n") <= leaf)
        done = done.select("path", "name")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = nodes.filter(F.col("n") > leaf)
        if level == depth or large.isEmpty():
            break
        paths = written(_branch(large.select("path", "name"), classes, threshold), "paths")
    # the same members meet in many trees: one node of each member set is enough
    same = leaves.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("name").cast("decimal(20,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(3), "name")).alias("x"),
    )
    one = same.groupBy("n", "s", "x").agg(F.min("path").alias("path")).select("path")
    members = leaves.join(one, "path").join(
        classes.select("name", "size", F.col("sketch").alias("content")), "name"
    )

    def forest(sizes: list, contents: list) -> list:
        tokens = np.frombuffer(b"".join(contents), dtype=np.uint32).reshape(-1, TOKENS)
        return _sketch_forest(tokens, np.array(sizes, dtype=np.int64), threshold)

    return _per_task(
        _in_blocks(members, "path", "name", block).select("task", "name", "size", "content"), forest
    )


def _with_sets(docs: DataFrame, text: str, roles: DataFrame, width: int) -> DataFrame:
    """``task, first, name, size, content``: ``roles`` (k1, k2, task, first, name) with the
    full set of the row that the key stands for."""

    # texts of other documents are passed over where they are read, by a bitmap of the
    # wanted keys whose size is bounded; what it lets through too much the join drops
    wanted = roles.select("k1").distinct()
    bits = min(MOST_BITS, max(16, wanted.count().bit_length() + 5))
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            maybe = in_bitmap(shared.value, np.asarray(whole.column(0)).view(np.uint64))
            for part in text_slices([whole.filter(pa.array(maybe))], 2, 1 << 20):
                values, offsets = unique_per_text(*text_shingles(*text_words(part.column(2)), width))
                sets = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(np.diff(offsets)), pa.array(sets, pa.binary())],
                    names=["k1", "k2", "size", "content"],
                )

    read = docs.select("__k1", "__k2", F.col(text)).mapInArrow(
        rows, "k1 long, k2 long, size long, content binary"
    )
    return read.join(roles, ["k1", "k2"]).select("task", "first", "name", "size", "content")


def _star_roles(groups: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """Every class with a smaller neighbour meets the smallest one, its hub: a class is sent
    once, a hub once for ``block`` of its classes, so the rows are linear in the classes."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = both.groupBy("a").agg(F.min("b").alias("hub")).filter("hub < a")
    slots = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).alias("slots"))
    placed = stars.join(slots, "hub").select(
        F.xxhash64("hub", F.pmod(F.xxhash64("a"), "slots")).alias("task"), "hub", F.col("a").alias("name")
    )
    hubs = placed.select("task", F.lit(0).alias("first"), F.col("hub").alias("name")).distinct()
    roles = placed.select("task", F.lit(1).alias("first"), "name").unionByName(hubs)
    return roles.join(groups.select("name", "k1", "k2"), "name")


def _star_edges(sets: DataFrame, percent: int) -> DataFrame:
    """The links of each star that hold on full sets; the hub is the first of its task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, hub, name = None, None, None
        for batch in batches:
            out = ([], [])
            columns = [batch.column(c).to_pylist() for c in range(4)]
            for at, first, one, content in zip(*columns, strict=True):
                values = np.frombuffer(content, dtype=np.uint64)
                if first == 0:
                    task, hub, name = at, values, one
                elif at == task:
                    place = np.minimum(np.searchsorted(hub, values), len(hub) - 1)
                    both = int(np.count_nonzero(hub[place] == values))
                    if 100 * both >= percent * (len(hub) + len(values) - both):
                        out[0].append(name), out[1].append(one)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])

    placed = sets.repartition("task").sortWithinPartitions("task", "first")
    return placed.select("task", "first", "name", "content").mapInArrow(rows, "a binary, b binary")


def _apart_roles(groups: DataFrame, parts: DataFrame, block: int, block_values: int) -> DataFrame:
    """Members of groups that are still in several parts, dealt so that every two members
    of different parts meet in a task.

    A part of half a block or more has blocks of its own, which meet the blocks of other
    parts only; all smaller parts of a group share blocks.  So a group of one part is sent
    nowhere, and one large part beside small ones once per block of the small ones."""
    members = groups.join(parts, "name", "left").withColumn("part", F.coalesce("part", "name"))
    sizes = members.groupBy("group", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("values")
    )
    open_groups = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    large = (F.col("n") * 2 >= block) | (F.col("values") * 2 >= block_values)
    sizes = sizes.join(open_groups.select("group"), "group").withColumn("own", F.when(large, F.col("part")))
    families = (
        sizes.groupBy("group", "own")
        .agg(F.sum("n").alias("n"), F.sum("values").alias("values"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("values") / block_values)))
    )
    numbered = families.select(
        "group", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    ).withColumn("id", F.xxhash64("group", "own", "i"))
    other = numbered.select("group", F.col("own").alias("own2"), F.col("id").alias("id2"))
    pairs = numbered.join(other, "group").filter(
        (F.col("id") < F.col("id2")) & ~(F.col("own").isNotNull() & F.col("own").eqNullSafe(F.col("own2")))
        | (F.col("id") == F.col("id2")) & F.col("own").isNull()
    )
    pairs = pairs.select(F.xxhash64("id", "id2").alias("task"), F.explode(F.array_distinct(F.array("id", "id2"))).alias("id"))
    placed = (
        members.join(sizes.select("group", "part", "own"), ["group", "part"])
        .withColumn("family", F.coalesce("own", F.lit(b"")))
        .join(families.select("group", F.coalesce("own", F.lit(b"")).alias("family"), "blocks"), ["group", "family"])
        .withColumn("id", F.xxhash64("group", "own", F.pmod(F.xxhash64("name"), "blocks")))
    )
    return placed.join(pairs, "id").select("k1", "k2", "task", F.lit(0).alias("first"), "name")


def confirmed_edges(
    docs: DataFrame, text: str, groups: DataFrame, edges: DataFrame, percent: int, width: int, block: int
) -> DataFrame:
    """Edges of links confirmed on full sets.  ``groups``: (name, size, group, k1, k2),
    where k1, k2 is the key of one row that has the class's set; ``edges`` are the
    candidates' own.

    First one candidate edge per class is confirmed, which is linear in the classes and
    joins most of a group of copies; then members of parts that are still apart meet."""
    stars = _with_sets(docs, text, written(_star_roles(groups, edges, block), "stars"), width)
    direct = written(_star_edges(stars, percent), "direct-edges")
    parts = components(direct).toDF("name", "part")
    roles = written(_apart_roles(groups, parts, block, BLOCK_VALUES), "apart")
    if roles.isEmpty():
        return direct

    def forest(_: list, contents: list) -> list:
        return _set_forest([np.frombuffer(c, dtype=np.uint64) for c in contents], percent)

    sets = _with_sets(docs, text, roles, width)
    return direct.unionByName(_per_task(sets.select("task", "name", "size", "content"), forest))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    width: int = 5,
    trees: int = 20,
    leaf: int = 2048,
    depth: int = 6,
    leaf_block: int = 16384,
    block: int = 1024,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` and the row keys ``__k1, __k2``, per row."""
    threshold = percent / 100
    slim = keyed(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")),
        F.col("id"),
        F.col("text"),
    )
    rows = written(document_sets(slim, "text", threshold, width, trees), "near-rows")
    classes = written(
        rows.filter("size > 0")
        .groupBy("name")
        .agg(
            F.min("id").alias("low"),
            F.min(F.struct("k1", "k2")).alias("key"),
            F.first("size").alias("size"),
            F.first("sketch").alias("sketch"),
            F.first("paths").alias("paths"),
        ),
        "near-classes",
    )
    paths = classes.select(F.explode("paths").alias("path"), "name")
    edges = written(
        candidate_edges(classes, paths, threshold, leaf, depth, leaf_block).distinct(), "near-edges"
    )
    groups = written(
        components(edges).withColumnsRenamed({"vertex": "name", "component": "group"})
        .join(classes.select("name", "size", "key"), "name")
        .select("name", "size", "group", "key.k1", "key.k2"),
        "near-candidates",
    )
    links = components(confirmed_edges(slim, "text", groups, edges, percent, width, block))
    labelled = classes.select("name", "low").join(
        links.withColumnRenamed("vertex", "name"), "name", "left"
    )
    label = written(
        labelled.select("name", "low", F.coalesce("component", "name").alias("component")),
        "near-labels",
    )
    lowest = label.groupBy("component").agg(F.min("low").alias("component_id"))
    named = label.join(lowest, "component").select("name", "component_id")
    return rows.select("k1", "k2", "id", "size", "name").join(named, "name", "left").select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("size") > 0, F.col("id").eqNullSafe(F.col("component_id")))
        .otherwise(F.lit(True))
        .alias("kept"),
        F.col("k1").alias("__k1"),
        F.col("k2").alias("__k2"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id;
    of rows equal in id and text one stays."""
    groups = near_groups(docs, id_col, text, **options)
    keys = ["__k1", "__k2"]
    dropped = written(groups.filter(~F.col("kept")).select(*keys).distinct(), "near-dropped")
    repeated = written(
        groups.filter("kept").groupBy(*keys).count().filter("count > 1").select(*keys),
        "near-repeated",
    )
    rows = keyed(without(docs, [*keys, "__maybe"]), F.col(id_col).cast("long"), F.col(text))
    # only rows whose key may be among the dropped ones are shuffled with their texts
    bits = min(MOST_BITS, max(16, dropped.count().bit_length() + 5))
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(dropped.select("__k1"), bits))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, key.to_numpy(dtype=np.int64).view(np.uint64)))

    flagged = rows.withColumn("__maybe", maybe("__k1"))
    left = flagged.filter(~F.col("__maybe")).unionByName(
        flagged.filter("__maybe").join(dropped, keys, "left_anti")
    ).drop("__maybe")
    if not repeated.isEmpty():
        left = left.join(repeated, keys, "left_anti").unionByName(
            left.join(repeated, keys, "left_semi").dropDuplicates(keys)
        )
    return left.drop(*keys)
