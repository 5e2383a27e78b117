"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by the size of their shingle set.  A partition with items
of at most U shingles gives each of them a signature of its
``floor((1 - t) * U) + 1`` minwise shingles (the smallest under one seeded
hash): a document that contains at least the share t of an item lacks at most
``floor((1 - t) * size)`` of its shingles, so it holds one of the signature at
least, and the search misses nothing at any document length.  Candidates are
verified by counting, exactly, the item's shingles in the document.

Documents are read once.  Their shingles pass a bitmap of the items' shingles,
whose size is a parameter and does not follow the items; what a full bitmap lets
through too much is sorted out by the joins.  Only hits are shuffled, as one
array per document.

Defined cases: null or empty texts, of items or documents, match nothing; an item
or document with fewer words than a shingle has its whole sequence as its one
shingle; equal rows give one row; items with equal shingle sets are searched once
and reported under their smallest id (null if all are null), with their number and all
their ids; ids of items and documents are whole numbers; empty tables give an empty
result; extra columns, also such as are named like an output, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import in_bitmap, key_bitmap, keyed, written
from skemata.llm.wordhash import mix, text_shingles, text_slices, text_words, unique_per_text

BITMAP_BITS = 24
SEED = np.uint64(0x5DEECE66D1234567)


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(__k1, __k2, id, shingles): the distinct shingle hashes of each row, ascending."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 3, 2 << 20):
            values, offsets = unique_per_text(*text_shingles(*text_words(part.column(3)), width))
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], lists], names=["k1", "k2", "id", "shingles"]
            )

    return docs.select("__k1", "__k2", "id", F.col(text)).mapInArrow(
        sets, "k1 long, k2 long, id long, shingles array<long>"
    )


def item_classes(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item, item_id, copies, members, shingles): items with equal shingle sets as one,
    named ``item`` by a hash of the set."""
    rows = shingle_sets(
        keyed(items.select(F.col(item_id).cast("long").alias("id"), F.col(text)), F.col(text)),
        text,
        width,
    ).filter(F.size("shingles") > 0)
    return (
        rows.groupBy("shingles")
        .agg(
            F.min("id").alias("item_id"),
            F.count(F.lit(1)).alias("copies"),
            F.sort_array(F.collect_set("id")).alias("members"),
        )
        .withColumn("item", F.xxhash64("shingles"))
    )


def signatures(classes: DataFrame, threshold: float) -> DataFrame:
    """(shingle, item, size_class): the minwise shingles of each item.

    Size classes double: items of 2^c to 2^(c+1) - 1 shingles are class c.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids, classes_out = [], [], []
            for item, values in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                shingles = np.array(values, dtype=np.int64)
                size_class = len(shingles).bit_length() - 1
                most = 2 ** (size_class + 1) - 1
                # a hair above, so that rounding never shortens a signature
                length = int((1 - threshold) * most + 1e-9) + 1
                order = np.argsort(mix(shingles.view(np.uint64) ^ SEED), kind="stable")[:length]
                tokens.append(shingles[order])
                ids += [item] * len(order)
                classes_out += [size_class] * len(order)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)),
                    pa.array(ids, pa.int64()),
                    pa.array(classes_out, pa.int32()),
                ],
                names=["shingle", "item", "size_class"],
            )

    return classes.select("item", "shingles").mapInArrow(
        rows, "shingle long, item long, size_class int"
    )


def document_hits(docs: DataFrame, text: str, width: int, bitmap: np.ndarray) -> DataFrame:
    """(k1, k2, id, n_shingles, hits) of the documents with a shingle in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for part in text_slices(batches, 3, 2 << 20):
            values, offsets = text_shingles(*text_words(part.column(3)), width)
            passed = np.flatnonzero(in_bitmap(flags, values))
            found, bounds = unique_per_text(values[passed], np.searchsorted(passed, offsets))
            some = np.flatnonzero(np.diff(bounds))
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(bounds[some], bounds[-1]).astype(np.int32)),
                pa.array(found.view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(some)) for c in part.columns[:3]], lists],
                names=["k1", "k2", "id", "hits"],
            )

    return docs.select("__k1", "__k2", "id", F.col(text)).mapInArrow(
        hits, "k1 long, k2 long, id long, hits array<long>"
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """One row per document and item class with containment of ``threshold`` or more:
    ``doc_id, item_id, item_copies, item_shingles, found, containment``, the class's
    ``members`` and the document's row key ``__k1, __k2``."""
    slim = keyed(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text)),
        F.col("id"),
        F.col(text),
    )
    classes = written(item_classes(items, item_id, item_text, width), "bench-items")
    shingles = classes.select(
        F.explode("shingles").alias("shingle"),
    )
    hits = written(
        document_hits(slim, text, width, key_bitmap(shingles.select("shingle"), bitmap_bits)), "bench-hits"
    ).dropDuplicates(["k1", "k2"])
    probes = hits.select("k1", "k2", F.explode("hits").alias("shingle"))
    candidates = (
        probes.join(signatures(classes, threshold), "shingle")
        .groupBy("k1", "k2", "item")
        .agg(F.count(F.lit(1)).alias("signature_hits"))
    )
    # candidates meet their item's whole set and their document's hits in the row
    verified = (
        candidates.join(classes.select("item", "item_id", "copies", "members", "shingles"), "item")
        .join(hits, ["k1", "k2"])
        .withColumn("found", F.size(F.array_intersect("shingles", "hits")))
        .withColumn("item_shingles", F.size("shingles"))
        .filter(F.col("found") >= F.ceil(F.lit(threshold) * F.col("item_shingles") - 1e-9))
    )
    return verified.select(
        F.col("id").alias("doc_id"),
        "item_id",
        F.col("copies").alias("item_copies"),
        F.col("item_shingles").cast("long"),
        F.col("found").cast("long"),
        (F.col("found") / F.col("item_shingles")).alias("containment"),
        "members",
        F.col("k1").alias("__k1"),
        F.col("k2").alias("__k2"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that contain a test item."""
    id_col, text = options.get("id_col", "doc_id"), options.get("text", "text")
    found = written(
        contaminated(docs, items, **options).select("__k1", "__k2").distinct(), "leaks"
    )
    # other columns go by numbers meanwhile: they may be named like a key
    names = [c if c in (id_col, text) else f"other{i}" for i, c in enumerate(docs.columns)]
    rows = keyed(docs.toDF(*names), F.col(id_col).cast("long"), F.col(text))
    left = rows.join(found, ["__k1", "__k2"], "left_anti").select(*names)
    return left.toDF(*docs.columns)
