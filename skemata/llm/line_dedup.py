"""Line dedup: keys found in many documents lose their lines.

Every line becomes (key hash, document key, position).  The rows are
range-partitioned by hash and document, so a line that a third of all documents
share is spread over many tasks, and sorted by hash, document and position.  Each
task streams its rows once, counts documents per key and returns the positions
to drop; a key that crosses a task border is settled from a few summary rows.
Per document the positions become a compressed keep bitmap.  Texts are not
sorted and not aggregated; they meet their bitmap in one join.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are always kept; equal rows count as separate
documents; a repeated line within one document counts once; an empty table
gives an empty result; columns of the input other than the text pass through,
and an input column named like an output is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import keyed, without, written
from skemata.llm.wordhash import text_slices

BLANKS = b" \t\n\r\x0b\x0c"
SORT_KEY = ["h1", "h2", "k1", "k2"]
OUTPUTS = ["kept_text", "n_lines", "n_dropped"]


def line_rows(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, k1, k2, pos) per line with a countable key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0, 2 << 20):
            k1, k2 = (np.asarray(part.column(c)) for c in (1, 2))
            digests, doc, pos = [], [], []
            digest = xxhash.xxh3_128_digest
            for i, value in enumerate(part.column(0).cast(pa.large_binary()).to_pylist()):
                for p, line in enumerate((value or b"").split(b"\n")):
                    key = line.strip(BLANKS).lower()
                    # code points are at most as many as bytes, so most lines need no decoding
                    if len(key) >= min_chars and (
                        len(key) >= 4 * min_chars or len(key.decode()) >= min_chars
                    ):
                        digests.append(digest(key))
                        doc.append(i)
                        pos.append(p)
            words = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            doc = np.array(doc, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(words[:, 0])),
                    pa.array(np.ascontiguousarray(words[:, 1])),
                    pa.array(k1[doc]),
                    pa.array(k2[doc]),
                    pa.array(np.array(pos, dtype=np.int32)),
                ],
                names=[*SORT_KEY, "pos"],
            )

    return docs.select(F.col(text), "__k1", "__k2").mapInArrow(
        rows, "h1 long, h2 long, k1 long, k2 long, pos int"
    )


class _Run:
    """One key's rows as they stream by: documents so far, rows held until decided."""

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first = key, first
        self.docs, self.held = 0, []
        self.doc, self.doc_pos = None, None

    def rows(self, columns: list[np.ndarray]) -> None:
        k1, k2, pos = columns
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        if self.doc == (k1[0], k2[0]):
            new[0] = False
        # a copy of a document repeats each of its positions; its first one counts it
        starts = np.flatnonzero(new)
        lowest = np.empty(len(k1), dtype=np.int64)
        group = np.cumsum(new) - 1
        lowest[:] = np.where(group >= 0, pos[starts][group] if len(starts) else 0, self.doc_pos)
        self.docs += int((pos == lowest).sum())
        self.doc, self.doc_pos = (k1[-1], k2[-1]), int(lowest[-1])


def _stream(min_docs: int):
    """Drop rows, rows pending at a border, and summary rows of border keys."""

    def out(kind: int, key: tuple[int, int], columns: list[np.ndarray], docs: int):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind, dtype=np.int32)),
                pa.array(np.full(n, key[0], dtype=np.int64)),
                pa.array(np.full(n, key[1], dtype=np.int64)),
                *[pa.array(c) for c in columns],
                pa.array(np.full(n, docs, dtype=np.int64)),
            ],
            names=["kind", *SORT_KEY, "pos", "docs"],
        )

    def joined(held):
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    def close(run: _Run, last: bool):
        border = run.first or last
        if run.docs >= min_docs and run.held:
            yield out(0, run.key, joined(run.held), 0)
        elif border and run.held:
            yield out(1, run.key, joined(run.held), 0)
        if border:
            zero = [np.zeros(1, dtype=t) for t in (np.int64, np.int64, np.int32)]
            yield out(2, run.key, zero, run.docs)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, k1, k2, pos = (np.asarray(c) for c in batch.columns)
            change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            bounds = np.array([0, *change, len(h1)])
            # fewer rows than min_docs inside a batch: nothing to drop, whatever they are
            matter = np.diff(bounds) >= min_docs
            matter[[0, -1]] = True
            for i in np.flatnonzero(matter):
                a, b = int(bounds[i]), int(bounds[i + 1])
                key = (int(h1[a]), int(h2[a]))
                if run is None or run.key != key:
                    if run is not None:
                        yield from close(run, False)
                    run, first = _Run(key, first), False
                columns = [k1[a:b], k2[a:b], pos[a:b]]
                if b - a == 1 and run.doc is None:  # most keys: one line in one document
                    run.docs, run.doc, run.doc_pos = 1, (k1[a], k2[a]), int(pos[a])
                else:
                    run.rows(columns)
                run.held.append(columns)
                if run.docs >= min_docs:
                    yield out(0, key, joined(run.held), 0)
                    run.held = []
        if run is not None:
            yield from close(run, True)

    return stream


def dropped_lines(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(k1, k2, pos) of every line whose key at least ``min_docs`` documents hold."""
    placed = line_rows(docs, text, min_chars).repartitionByRange(*SORT_KEY)
    found = written(
        placed.sortWithinPartitions(*SORT_KEY, "pos").mapInArrow(
            _stream(min_docs),
            "kind int, h1 long, h2 long, k1 long, k2 long, pos int, docs long",
        ),
        "line-dedup",
    )
    # two summaries per task at most; a key in several tasks is the sum of its parts
    crossing = (
        found.filter("kind = 2")
        .groupBy("h1", "h2")
        .agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
    )
    settled = found.filter("kind = 1").join(crossing.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return found.filter("kind = 0").select("k1", "k2", "pos").unionByName(
        settled.select("k1", "k2", "pos")
    )


def pack(positions: np.ndarray) -> bytes:
    """Compressed bitmap in which a set bit marks a dropped line; later lines are kept."""
    flags = np.zeros(int(positions.max()) + 1, dtype=bool)
    flags[positions] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """True for each line to keep."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines]
    keep = np.ones(n_lines, dtype=bool)
    keep[: len(bits)] = bits == 0
    return keep


def keep_bitmaps(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """(k1, k2, bitmap) per document that loses a line; ``docs`` carries ``__k1, __k2``."""

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            offsets = offsets - offsets[0]
            packed = [
                pack(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                names=["k1", "k2", "bitmap"],
            )

    # one document's positions are bounded by its own lines
    per_doc = (
        dropped_lines(docs, text, min_docs, min_chars)
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("positions"))
    )
    return per_doc.mapInArrow(bitmaps, "k1 long, k2 long, bitmap binary")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    docs = keyed(without(docs, [*OUTPUTS, "__k1", "__k2"]), F.col(id_col), F.col(text))
    bitmaps = written(keep_bitmaps(docs, text, min_docs, min_chars), "keep-bitmaps")
    matched = docs.join(
        bitmaps.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "bitmap": "__bitmap"}),
        ["__k1", "__k2"],
        "left",
    )
    kept_columns = [c for c in docs.columns if c not in ("__k1", "__k2")]
    slim = matched.select(*kept_columns, "__bitmap")
    at_text = kept_columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at_text, 2 << 20):
            kept, lines, dropped = [], [], []
            columns = part.columns
            for value, bitmap in zip(
                columns[at_text].cast(pa.large_binary()).to_pylist(),
                columns[-1].to_pylist(),
                strict=True,
            ):
                value = value or b""
                n = value.count(b"\n") + 1
                gone = 0
                if bitmap is not None:
                    pieces = value.split(b"\n")
                    keep = unpack(bitmap, n)
                    gone = n - int(keep.sum())
                    value = b"\n".join([pieces[i] for i in np.flatnonzero(keep)])
                kept.append(value)
                lines.append(n)
                dropped.append(gone)
            yield pa.RecordBatch.from_arrays(
                [
                    *columns[:-1],
                    pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
                    pa.array(lines, pa.int64()),
                    pa.array(dropped, pa.int64()),
                ],
                names=[*kept_columns, *OUTPUTS],
            )

    schema = slim.drop("__bitmap").schema
    for name, kind in zip(OUTPUTS, ("string", "long", "long"), strict=True):
        schema = schema.add(name, kind)
    return slim.mapInArrow(apply, schema)
