"""Quality rules: a decision list learned from labelled statistics.

Statistics are counted over every word, line and character of a text.  Sequential
covering then learns rules for low quality on a bounded sample of labelled rows: a
rule grows, threshold by threshold, by information gain on one part of the rows,
and loses trailing conditions again while that helps on the other part; rows that
it covers are set aside and the next rule is learned.  A rule that is not precise
enough on rows it was not grown on ends the search.  The result is an ordered list
of threshold conjunctions, emitted as one Spark ``CASE`` expression that runs in
generated code.

Defined cases: a null or empty text has no words and fails the base checks; without
labelled rows of both classes the list is empty and keeps all; ids and labels do
not enter a verdict, so repeated texts get equal ones; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import keyed, per_group_sample, remainder
from skemata.llm.wordhash import (
    byte_view,
    mix,
    span_hashes,
    text_slices,
    window_hashes,
    word_spans,
)

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_letters", "n_digits", "n_marks",
]
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:"
BLANKS = " \t\n\r\x0b\x0c"


def _flags(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_BYTES = {
    "n_symbols": _flags(SYMBOLS),
    "n_upper": _flags(range(65, 91)),
    # letters of ASCII, and code points above it, nearly all of them letters
    "n_letters": _flags([*range(65, 91), *range(97, 123), *range(0xC0, 256)]),
    "n_digits": _flags(range(48, 58)),
    "n_marks": _flags(MARKS),
    # bytes that begin a code point, but for blanks
    "word_chars": _flags(b for b in range(256) if not 0x80 <= b < 0xC0 and chr(b) not in BLANKS),
}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = byte_view(texts)
    out = {name: _per_text(flags[data], offsets) for name, flags in _BYTES.items()}
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, False)
    bounds = np.searchsorted(starts, offsets)
    out["n_words"] = np.diff(bounds)
    # three-word windows, those across a text border left out; equal ones by text
    text_of = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
    covered = np.zeros(len(words), dtype=bool)
    windows = window_hashes(words, 3)
    inside = np.flatnonzero(text_of[2:] == text_of[:-2]) if len(words) > 2 else np.empty(0, int)
    if len(inside):
        with np.errstate(over="ignore"):
            named = mix(windows[inside] + text_of[inside] * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(named, kind="stable")
        equal = named[order][1:] == named[order][:-1]
        again = np.zeros(len(inside), dtype=bool)
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
        for d in range(3):
            covered[inside[again] + d] = True
    out["n_repeat_words"] = _per_text(covered, bounds)
    dups, lines = [], []
    for value in texts.to_pylist():
        rows = (value or "").split("\n")
        solid = [r for r in rows if r.strip(BLANKS)]
        lines.append(len(rows))
        dups.append(len(solid) - len(set(solid)))
    out["n_dup_lines"], out["n_lines"] = np.array(dups), np.array(lines)
    return out


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and COUNTS."""
    at = docs.columns.index(text)
    places = [i for i, c in enumerate(docs.columns) if c != text]
    names = [*[docs.columns[i] for i in places], *COUNTS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at, 1 << 20):
            counts = text_counts(part.column(at))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i) for i in places],
                    *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                ],
                names=names,
            )

    schema = docs.drop(text).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return docs.mapInArrow(rows, schema)


def statistics() -> dict[str, Column]:
    """What rules may test, by name: shares and means of the counts."""

    def over(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_word_share": over("n_repeat_words", "n_words"),
        "words_per_line": over("n_words", "n_lines"),
        "upper_share": over("n_upper", "n_letters"),
        "letter_share": over("n_letters", "word_chars"),
        "digit_share": over("n_digits", "word_chars"),
        "marks_per_word": over("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.limit:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, stats: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(stats.values()))), dtype=bool)
    for t in rule:
        out &= (stats[t.name] >= t.limit) if t.above else (stats[t.name] < t.limit)
    return out


def _best_test(stats: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the highest information gain, over all cut points."""
    p, n = int(bad.sum()), len(bad)
    base = np.log2(p / n)
    best, found = 1e-9, None
    for name, values in stats.items():
        order = np.argsort(values, kind="stable")
        v, hits = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below_p, below_n = hits[cuts - 1], cuts
        for above, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1e-12) / cn) - base), -1)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best = float(gain[i])
                found = Test(name, above, float((v[cuts[i]] + v[cuts[i] - 1]) / 2))
    return best, found


def grow(stats: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    rule: list[Test] = []
    while len(rule) < most_tests and bad.any() and not bad.all():
        _, test = _best_test(stats, bad)
        if test is None:
            break
        rule.append(test)
        keep = covers((test,), stats)
        stats = {k: v[keep] for k, v in stats.items()}
        bad = bad[keep]
    return tuple(rule)


def _worth(rule: Rule, stats: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covers(rule, stats)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, stats: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on."""
    cut = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(cut, key=lambda r: (_worth(r, stats, bad), -len(r)), default=())


def learn_list(
    stats: dict[str, np.ndarray],
    bad: np.ndarray,
    most_rules: int = 20,
    most_tests: int = 6,
    precision: float = 0.9,
    least: int = 5,
    seed: int = 13,
) -> list[Rule]:
    """Ordered rules for low quality.  A rule needs ``precision`` and ``least`` covered
    rows on the part it was not grown on."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    misses = 0
    while len(rules) < most_rules and misses < 3 and (left & bad).sum() >= least:
        rows = np.flatnonzero(left)
        rng.shuffle(rows)
        cut = 2 * len(rows) // 3
        parts = [({k: v[i] for k, v in stats.items()}, bad[i]) for i in (rows[:cut], rows[cut:])]
        (grow_stats, grow_bad), (check_stats, check_bad) = parts
        rule = prune(grow(grow_stats, grow_bad, most_tests), check_stats, check_bad)
        hit = covers(rule, check_stats) if rule else np.zeros(len(check_bad), dtype=bool)
        if not rule or hit.sum() < least or (hit & check_bad).sum() < precision * hit.sum():
            misses += 1  # another split of the rows may still find one
            continue
        misses = 0
        rules.append(rule)
        left &= ~covers(rule, stats)
    return rules


def low_quality(rules: list[Rule]) -> Column:
    """The list as one conditional expression over the columns COUNTS: the number (from
    1) of the first rule that holds, or 0."""
    columns = statistics()
    verdict = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for t in rule:
            value = columns[t.name]
            holds = holds & ((value >= t.limit) if t.above else (value < t.limit))
        verdict = F.when(holds, number) if verdict is None else verdict.when(holds, number)
    return F.lit(0) if verdict is None else verdict.otherwise(0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = 10000,
    **options,
) -> list[Rule]:
    """Learns from at most ``per_class`` labelled rows of each class."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label"))
    rows = keyed(
        docs.filter(remainder(id_col) != 2).select(F.col(id_col).alias("__id"), F.col(text).alias("text")),
        F.col("__id"),
    )
    sample = per_group_sample(
        known.filter("label in (0, 1)").join(rows.select("__id", "__k1", "__k2"), "__id"),
        "label",
        per_class,
        2,
        seed=31,
    )
    columns = statistics()
    found = (
        with_counts(
            rows.join(F.broadcast(sample.select("__id", "label")), "__id").select("label", "text")
        )
        .select("label", *[c.alias(n) for n, c in columns.items()])
        .toPandas()
        .sort_values(["label", *columns], kind="stable")
    )
    bad = (found["label"] == 0).to_numpy()
    if bad.all() or not bad.any():
        return []
    return learn_list({n: found[n].to_numpy(dtype=np.float64) for n in columns}, bad, **options)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """Id, COUNTS, ``base_failed``, ``rule`` (first rule that holds, or 0) and ``kept``."""
    rules = learn(docs, labels, id_col, text, **options)
    counted = with_counts(docs.select(F.col(id_col), F.col(text)), text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("rule", low_quality(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
