"""Token counts: each distinct pre-token is counted once, documents only sum.

Three steps.  (1) The pre-tokens of all texts and how often each occurs, merged per task
before they are shuffled.  (2) The number of tokens of each distinct pre-token, once, by
the last-token programme over its prefixes; ids of texts are never made.  (3) Every
document's pre-token frequencies meet these numbers.  The ``BROADCAST_PIECES`` most
frequent pre-tokens at most go to every task, a bound that does not move with the data;
the frequencies of all rarer ones are joined by a shuffle, where no key is hot, because
frequent pre-tokens are in the broadcast part.  The result is the same at any bound.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special token's string
inside a text is one token, as the file says; equal rows give equal rows; an empty table
gives an empty result; texts of any length are counted whole.  The result has the other
columns of the input but not the text; a column named like an output is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from skemata.llm.bpe import vocabulary
from skemata.llm.common import without, written
from skemata.llm.pretokens import (
    Classes,
    Cutter,
    Remembered,
    letter_classes,
    special_pattern,
    special_tokens,
)
from skemata.llm.wordhash import text_slices

# Pre-tokens that every task gets; about 25 MB in a worker.
BROADCAST_PIECES = 200_000
# Words whose number of tokens a worker remembers.
WORDS_REMEMBERED = 150_000
# Distinct words and pre-tokens that a task gathers before it sends them on.
GATHERED = 400_000
# Frequencies above this share one step of the histogram that sets the broadcast part.
FREQUENT = 20_000


class Frequencies:
    """A text's pre-token frequencies as those of its words, cut one by one, and those of
    the pieces between words."""

    def __init__(self, classes: Classes, special: dict[str, int]):
        self.cut = Cutter(classes)
        self._special = special_pattern(special)

    def of(self, text: str, words: Counter, pieces: Counter) -> int:
        """Adds to both counters; returns the number of special tokens."""
        if self._special is None or not self._special.search(text):
            self._add(text, words, pieces)
            return 0
        n, begin = 0, 0
        for match in self._special.finditer(text):
            self._add(text[begin : match.start()], words, pieces)
            n, begin = n + 1, match.end()
        self._add(text[begin:], words, pieces)
        return n

    def _add(self, text: str, words: Counter, pieces: Counter) -> None:
        for first, rest in self.cut.stretches(text):
            if first:
                pieces.update(self.cut(first))
            words.update(rest)


def piece_frequencies(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """``piece, n``: the distinct pre-tokens of all texts and how often each occurs."""
    classes, special = letter_classes(), special_tokens(vocab_path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, words, seen = Frequencies(classes, special), Counter(), Counter()

        def gathered() -> Iterator[pa.RecordBatch]:
            for word, times in words.items():
                for piece in frequencies.cut.word(word):
                    seen[piece] += times
            words.clear()
            names, counts = list(seen), list(seen.values())
            for i in range(0, len(names), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[i : i + 20_000]), pa.array(counts[i : i + 20_000], pa.int64())],
                    names=["piece", "n"],
                )
            seen.clear()

        for part in text_slices(batches, 0, 1 << 20):
            for t in part.column(0).to_pylist():
                if t:
                    frequencies.of(t, words, seen)
            if len(words) + len(seen) >= GATHERED:
                yield from gathered()
        if words or seen:
            yield from gathered()

    found = docs.select(text).mapInArrow(rows, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def counted_pieces(pieces: DataFrame, vocab_path: str) -> DataFrame:
    """``piece, n, tokens``: how many tokens each distinct pre-token has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for part in text_slices(batches, 0):
            tokens = [vocab.count_piece(p.encode()) for p in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(tokens, pa.int64())], names=["piece", "n", "tokens"]
            )

    return pieces.select("piece", "n").mapInArrow(rows, "piece string, n long, tokens long")


def frequent_from(pieces: DataFrame, most: int) -> int:
    """The least frequency from which on there are at most ``most`` pre-tokens."""
    step = F.least("n", F.lit(FREQUENT)).alias("n")
    found = pieces.groupBy(step).count().orderBy(F.desc("n")).collect()
    total, least = 0, FREQUENT + 1
    for row in found:
        total += row["count"]
        if total > most:
            break
        least = row["n"]
    return least


def count_tokens(
    docs: DataFrame, vocab_path: str, text: str = "text", most: int = BROADCAST_PIECES
) -> DataFrame:
    """``docs`` without its texts, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    spark = docs.sparkSession
    classes, special = letter_classes(), special_tokens(vocab_path)
    pieces = written(counted_pieces(piece_frequencies(docs, vocab_path, text), vocab_path), "pieces")
    least = frequent_from(pieces, most)
    table = pieces.filter(F.col("n") >= least).select("piece", "tokens").toArrow()
    frequent = spark.sparkContext.broadcast(
        dict(zip(table["piece"].to_pylist(), table["tokens"].to_pylist(), strict=True))
    )

    others = without(docs.drop(text), ["n_bytes", "n_tokens"])
    names = {f"c{i}": c for i, c in enumerate(others.columns)}
    given = docs.select(
        docs[f"`{text}`"].alias("t"), *[docs[f"`{c}`"].alias(k) for k, c in names.items()]
    )
    rare_kind = ArrayType(StructType().add("piece", StringType()).add("times", LongType()))
    schema = StructType([StructField(k, others.schema[c].dataType) for k, c in names.items()])
    schema = schema.add("n_bytes", LongType()).add("known", LongType()).add("rare", rare_kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, known = Frequencies(classes, special), frequent.value.get

        def word_tokens(word: str) -> int:
            """Tokens of a word after a space; -1 if one of its pieces is not at hand."""
            counts = [known(piece) for piece in frequencies.cut.word(word)]
            return -1 if None in counts else sum(counts)

        tokens_of = Remembered(word_tokens, WORDS_REMEMBERED)
        kind = pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))
        for part in text_slices(batches, 0, 1 << 20):
            sizes, sums, rares = [], [], []
            for t in part.column(0).to_pylist():
                words, pieces, total = Counter(), Counter(), 0
                if t:
                    total = frequencies.of(t, words, pieces)
                for word, times in words.items():
                    tokens = tokens_of[word]
                    if tokens >= 0:
                        total += tokens * times
                    else:
                        for piece in frequencies.cut.word(word):
                            pieces[piece] += times
                rare = []
                for piece, times in pieces.items():
                    tokens = known(piece)
                    if tokens is None:
                        rare.append({"piece": piece, "times": times})
                    else:
                        total += tokens * times
                sizes.append(len(t.encode()) if t else 0)
                sums.append(total)
                rares.append(rare)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rares, kind)],
                names=[*names, "n_bytes", "known", "rare"],
            )

    # written: the rows' numbers must not change when a task runs again
    parts = written(
        given.mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id()), "counted"
    )
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.piece", "r.times")
    sums = (
        rare.join(pieces.select("piece", "tokens"), "piece")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    )
    return parts.join(sums, "row", "left").select(
        *[F.col(k).alias(c) for k, c in names.items()],
        "n_bytes",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"),
    )
