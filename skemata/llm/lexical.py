"""Ranked lexical search of items over all documents by a dual tree.

A document is a sparse vector of term impacts, an item one of term weights; the score is
their product, in whole numbers.  Items and documents are each put into a hierarchy whose
nodes hold, for every term, the largest value of any member.  The product of two nodes'
maxima is then a bound on every score between their members, and a pair of nodes whose
bound is below the weakest kth score of the node's items is dropped with all it holds:
no score that counts is lost.  Pairs are taken largest bound first.

Documents stay where they are: each task builds trees over ``TREE_DOCS`` of its documents
at a time and keeps k rows per item, so only tasks x items x k rows are shuffled.  A pass
over the documents takes one block of items (``BLOCK_ITEMS``, ``BLOCK_TERMS`` at most);
more items mean more passes.  Before the search, a first pass counts the corpus (whole),
and the kth scores within about ``SEED_DOCS`` documents give every task lower bounds on
the final kth scores to start from; they drop nothing that could rank.

Defined cases: a null text and one without terms have no terms; such documents do not
count in N, are never ranked, and such items have no rows; fewer than k documents with a
score above 0 give fewer rows; equal scores rank by ascending document id, a null id last,
rows with equal ids in any order; every row of the item table is ranked for itself, also
with a null or repeated id; an empty table on either side gives an empty result; other
columns, whatever their names, are ignored.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from skemata.llm.common import written
from skemata.llm.wordhash import byte_view, span_hashes, text_slices, word_spans

BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 16
TREE_DOCS = 4096
SEED_DOCS = 4096
# Members of a leaf and children of an inner node.
DOC_LEAF, ITEM_LEAF, FAN = 8, 8, 8
# How often the rows of a tree are split to put alike ones side by side.
DEEPEST = 6

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts, A-Z folded, and n + 1 offsets into them."""
    data, offsets = byte_view(texts)
    starts, ends = word_spans(data, offsets, _GAPS)
    return span_hashes(data, starts, ends, fold=True), np.searchsorted(starts, offsets)


def frequencies(
    terms: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the sorted vocabulary and occurrences of the terms found in it."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(vocabulary):
        return (np.empty(0, dtype=np.int64),) * 3
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[vocabulary >> np.uint64(48)] = True
    hit = np.flatnonzero(maybe[terms >> np.uint64(48)])
    place = np.minimum(np.searchsorted(vocabulary, terms[hit]), len(vocabulary) - 1)
    found = vocabulary[place] == terms[hit]
    keys, times = np.unique(
        rows[hit[found]] * len(vocabulary) + place[found], return_counts=True
    )
    return keys // len(vocabulary), keys % len(vocabulary), times


class Vectors:
    """Sparse rows: entries ``ptr[i]:ptr[i + 1]`` of ``terms`` and ``values``."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.ptr, self.terms, self.values = ptr, terms, values

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def taken(self, order: np.ndarray) -> Vectors:
        sizes = np.diff(self.ptr)[order]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ptr[:-1][order] - ptr[:-1], sizes) + np.arange(ptr[-1])
        return Vectors(ptr, self.terms[at], self.values[at])

    def maxima(self, size: int, n_terms: int) -> Vectors:
        """One row for each ``size`` neighbouring rows: the largest value of every term."""
        n = -(-len(self) // size)
        group = np.repeat(np.arange(len(self)) // size, np.diff(self.ptr))
        keys = group * n_terms + self.terms
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        values = np.maximum.reduceat(self.values[order], first)
        ptr = np.searchsorted(keys[first], np.arange(n + 1) * n_terms)
        return Vectors(ptr, keys[first] % n_terms, values)


def neighbours_first(rows: Vectors, scale: np.ndarray, leaf: int) -> np.ndarray:
    """An order that puts alike rows side by side.  Of a set, ``FAN`` rows are picked, each
    the least like all picked before; every row goes to the one it is most like, and the
    parts are treated in the same way, ``DEEPEST`` times at most.  No row is empty."""
    weights = rows.values * scale[rows.terms]
    norm = np.sqrt(np.add.reduceat(weights * weights, rows.ptr[:-1])) + 1e-9
    whole = Vectors(rows.ptr, rows.terms, weights / np.repeat(norm, np.diff(rows.ptr)))
    scratch = np.zeros(len(scale))
    out: list[np.ndarray] = []
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        ids, depth = todo.pop()
        if len(ids) <= leaf or depth == DEEPEST:
            out.append(ids)
            continue
        part, pick = whole.taken(ids), 0
        likeness = np.empty((FAN, len(ids)))
        for j in range(FAN):
            one = slice(part.ptr[pick], part.ptr[pick + 1])
            scratch[part.terms[one]] = part.values[one]
            likeness[j] = np.add.reduceat(scratch[part.terms] * part.values, part.ptr[:-1])
            scratch[part.terms[one]] = 0
            pick = int(np.argmin(likeness[: j + 1].max(axis=0)))
        label = np.argmax(likeness, axis=0)
        groups = [g for g in (ids[label == j] for j in range(FAN)) if len(g)]
        if len(groups) == 1:
            out.append(ids)
        else:
            todo += [(g, depth + 1) for g in groups[::-1]]
    return np.concatenate(out)


class Tree:
    """Levels of maxima over rows in ``order``: the rows, leaves, and so on to one root."""

    def __init__(self, rows: Vectors, scale: np.ndarray, leaf: int):
        self.order = neighbours_first(rows, scale, leaf)
        self.levels = [rows.taken(self.order)]
        self.span = [1]
        while len(self.levels[-1]) > 1 or len(self.levels) == 1:
            size = leaf if len(self.levels) == 1 else FAN
            self.levels.append(self.levels[-1].maxima(size, len(scale)))
            self.span.append(self.span[-1] * size)
        self.size = [1, leaf] + [FAN] * (len(self.levels) - 2)

    def children(self, level: int, node: int) -> tuple[int, int]:
        """First and last + 1 of a node's children, one level below."""
        begin = node * self.size[level]
        return begin, min(begin + self.size[level], len(self.levels[level - 1]))


class Items:
    """The hierarchy over a block's items, with kth scores as the search goes on."""

    def __init__(self, rows: Vectors, n_terms: int, k: int, floors: np.ndarray):
        self.k = k
        self.tree = Tree(rows, np.ones(n_terms), ITEM_LEAF)
        self.best: list[list] = [[] for _ in range(len(rows))]
        self.kth = floors[self.tree.order].copy()
        self.nodes: list[list[tuple]] = [[]]
        for level in range(1, len(self.tree.levels)):
            below, found = self.tree.levels[level - 1], []
            for node in range(len(self.tree.levels[level])):
                low, high = self.tree.children(level, node)
                at = slice(below.ptr[low], below.ptr[high])
                columns, place = np.unique(below.terms[at], return_inverse=True)
                kids = np.zeros((high - low, len(columns) + 1), dtype=np.int64)
                kids[np.repeat(np.arange(high - low), np.diff(below.ptr[low : high + 1])), place] = (
                    below.values[at]
                )
                column_of = np.full(n_terms, len(columns), dtype=np.int32)
                column_of[columns] = np.arange(len(columns))
                found.append((column_of, kids, kids.max(axis=0, keepdims=True)))
            self.nodes.append(found)
        self.top = len(self.nodes) - 1

    def weakest(self, level: int, node: int) -> int:
        span = self.tree.span[level]
        return int(self.kth[node * span : (node + 1) * span].min())

    def offer(self, item: int, score: int, doc) -> None:
        best = self.best[item]
        entry = (-score, doc is None, doc)
        if len(best) == self.k:
            if not _before(entry, best[-1]):
                return
            best.pop()
        insort(best, entry, key=_Ranked)
        if len(best) == self.k:
            self.kth[item] = max(self.kth[item], -best[-1][0])


def _before(a: tuple, b: tuple) -> bool:
    """Whether a ranks before b; ids are compared only if there are two."""
    return a[:2] < b[:2] or (a[:2] == b[:2] and not a[1] and a[2] < b[2])


class _Ranked:
    def __init__(self, entry: tuple):
        self.entry = entry

    def __lt__(self, other: _Ranked) -> bool:
        return _before(self.entry, other.entry)


def products(weights: np.ndarray, column_of: np.ndarray, docs: Vectors, low: int, high: int) -> np.ndarray:
    """Rows of ``weights`` times the rows ``low`` to ``high`` of ``docs``."""
    at = slice(docs.ptr[low], docs.ptr[high])
    columns = column_of[docs.terms[at]]
    known = np.flatnonzero(columns < weights.shape[1] - 1)
    parts = weights[:, columns[known]] * docs.values[at][known]
    sums = np.zeros((len(weights), len(known) + 1), dtype=np.int64)
    np.cumsum(parts, axis=1, out=sums[:, 1:])
    edges = np.searchsorted(known, docs.ptr[low : high + 1] - docs.ptr[low])
    return np.diff(sums[:, edges], axis=1)


def search_tree(items: Items, docs: Tree, ids: list) -> tuple[int, int]:
    """Offers every document that may rank to its items.  Returns how many pairs of item
    and document were scored, and how many there are."""
    scored = 0
    top = (items.top, 0, len(docs.levels) - 1, 0)
    todo = [(-math.inf, top)]
    while todo:
        bound, (i_level, i_node, d_level, d_node) = heapq.heappop(todo)
        if -bound < items.weakest(i_level, i_node):
            continue
        column_of, kids, own = items.nodes[i_level][i_node]
        if i_level == d_level == 1:
            i_low, i_high = items.tree.children(1, i_node)
            low, high = docs.children(1, d_node)
            scores = products(kids, column_of, docs.levels[0], low, high)
            scored += scores.size
            keep = (scores > 0) & (scores >= items.kth[i_low:i_high, None])
            for i, d in np.argwhere(keep).tolist():
                items.offer(i_low + i, int(scores[i, d]), ids[docs.order[low + d]])
            continue
        if i_level > 1:
            i_low, below = items.tree.children(i_level, i_node)[0], i_level - 1
        else:
            kids, i_low, below = own, i_node, i_level
        if d_level > 1:
            (low, high), d_below = docs.children(d_level, d_node), d_level - 1
        else:
            low, high, d_below = d_node, d_node + 1, d_level
        bounds = products(kids, column_of, docs.levels[d_below], low, high)
        for i in range(len(bounds)):
            weakest = items.weakest(below, i_low + i)
            for d, b in enumerate(bounds[i].tolist()):
                if b > 0 and b >= weakest:
                    heapq.heappush(todo, (-b, (below, i_low + i, d_below, low + d)))
    return scored, len(items.kth) * len(docs.order)


def item_blocks(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Blocks of items: ids, bounds, and the terms with their repeats of each item."""
    names = ["ids", "ptr", "terms", "times"]
    schema = StructType(
        [
            StructField("ids", ArrayType(items.schema[item_id].dataType)),
            StructField("ptr", ArrayType(IntegerType())),
            StructField("terms", ArrayType(LongType())),
            StructField("times", ArrayType(LongType())),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ptr, terms, times, kind = [], [0], [], [], None

        def block() -> pa.RecordBatch:
            columns = [ids, ptr, np.concatenate(terms), np.concatenate(times)]
            kinds = [kind, pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], pa.list_(t)) for c, t in zip(columns, kinds, strict=True)], names=names
            )

        for part in text_slices(batches, 1):
            kind = part.column(0).type
            found, offsets = text_terms(part.column(1))
            for i, one in enumerate(part.column(0).to_pylist()):
                own, n = np.unique(found[offsets[i] : offsets[i + 1]], return_counts=True)
                if not len(own):
                    continue
                if ids and (len(ids) == BLOCK_ITEMS or ptr[-1] + len(own) > BLOCK_TERMS):
                    yield block()
                    ids, ptr, terms, times = [], [0], [], []
                ids.append(one)
                ptr.append(ptr[-1] + len(own))
                terms.append(own.view(np.int64))
                times.append(n)
        if ids:
            yield block()

    return items.select(item_id, text).mapInArrow(rows, schema)


def corpus_counts(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents hold each of
    ``vocabulary``; each task sends one row per term of the block it has met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = np.zeros(len(vocabulary) + 2, dtype=np.int64)
        for part in text_slices(batches, 0):
            terms, offsets = text_terms(part.column(0))
            _, place, _ = frequencies(terms, offsets, vocabulary)
            holders[2:] += np.bincount(place, minlength=len(vocabulary))
            holders[:2] += (np.count_nonzero(np.diff(offsets)), len(terms))
        at = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(holders[at])], names=["at", "n"])

    found = texts.mapInArrow(rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 2, dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return int(out[0]), int(out[1]), out[2:]


def term_weights(n: int, holders: np.ndarray) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * n + 2) / (2 * h + 1))) for h in holders.tolist()], dtype=np.int64
    )


def impacts(tf: np.ndarray, terms: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What ``tf`` occurrences count in a document of ``terms`` terms, at most 10^6."""
    m = 75 + 25 * terms * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def top_documents(
    docs: DataFrame, block: Vectors, n_terms: int, k: int, floors: np.ndarray,
    vocabulary: np.ndarray, n_docs: int, all_terms: int,
) -> DataFrame:
    """``item, doc_id, score``: each task's k best documents per item of the block."""
    largest = np.zeros(n_terms)
    np.maximum.at(largest, block.terms, block.values)
    schema = StructType(
        [
            StructField("item", IntegerType()),
            StructField("doc_id", docs.schema[docs.columns[0]].dataType),
            StructField("score", LongType()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, n_terms, k, floors)
        ids, sizes, terms, values, kind = [], [], [], [], None

        def search() -> None:
            rows = Vectors(
                np.concatenate([[0], np.cumsum(np.concatenate(sizes))]),
                np.concatenate(terms), np.concatenate(values),
            )
            search_tree(items, Tree(rows, largest, DOC_LEAF), ids)

        for part in text_slices(batches, 1):
            kind = part.column(0).type
            found, offsets = text_terms(part.column(1))
            row, place, tf = frequencies(found, offsets, vocabulary)
            if not len(row):
                continue
            held, count = np.unique(row, return_counts=True)
            ids += part.column(0).take(pa.array(held)).to_pylist()
            sizes.append(count)
            terms.append(place)
            values.append(impacts(tf, np.diff(offsets)[row], n_docs, all_terms))
            if len(ids) >= TREE_DOCS:
                search()
                ids, sizes, terms, values = [], [], [], []
        if ids:
            search()
        if kind is None:
            return
        out = [
            (int(item), entry[2], -entry[0])
            for item, best in zip(items.tree.order, items.best, strict=True)
            for entry in best
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int32()),
                pa.array([x[1] for x in out], kind),
                pa.array([x[2] for x in out], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    return docs.mapInArrow(rows, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(doc_id, text)
    kind = items.schema[item_id]
    blocks = written(item_blocks(items, item_id, text), "items")
    out = None
    for block in blocks.toLocalIterator():
        terms = np.array(block.terms, dtype=np.int64).view(np.uint64)
        vocabulary, place = np.unique(terms, return_inverse=True)
        n_docs, all_terms, holders = corpus_counts(docs.select(text), vocabulary)
        if not all_terms:
            break
        weights = term_weights(n_docs, holders)[place] * np.array(block.times, dtype=np.int64)
        rows = Vectors(np.array(block.ptr, dtype=np.int64), place, weights)
        fixed = (len(vocabulary), k)
        corpus = (vocabulary, n_docs, all_terms)

        floors = np.zeros(len(rows), dtype=np.int64)
        draw = F.pmod(F.xxhash64(docs[doc_id], docs[text]), F.lit(n_docs)) < SEED_DOCS
        seeds = ranked(top_documents(docs.filter(draw), rows, *fixed, floors, *corpus), k)
        for row in seeds.filter(F.col("rank") == k).collect():
            floors[row["item"]] = row["score"]

        names = spark.createDataFrame(
            list(enumerate(block.ids)),
            StructType([StructField("item", IntegerType()), StructField("item_id", kind.dataType)]),
        )
        found = ranked(top_documents(docs, rows, *fixed, floors, *corpus), k)
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    if out is None:
        empty = StructType(
            [
                StructField("item_id", kind.dataType),
                StructField("rank", IntegerType()),
                StructField("doc_id", docs.schema[doc_id].dataType),
                StructField("score", LongType()),
            ]
        )
        return spark.createDataFrame([], empty)
    return out
