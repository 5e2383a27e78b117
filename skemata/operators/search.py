"""Nearest vectors by cosine similarity: exact per group, and approximate.

Scores are computed with numpy inside tasks.  A task keeps only the best k of
each question, so pairs never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.scale import skew_join, top_rows

# Vectors of one group that are scored at once, and scores that a task holds.
SHARD_ROWS = 20_000
SCORES = 2_000_000
# Vectors of lanes whose scores are gathered before the best are picked.
BUFFER = 2_000
# Vectors, and questions, of one group that meet in one task.
TASK_ROWS = 100_000
TASK_QUESTIONS = 10_000
# Vectors that a bucket of the approximate search is to hold, about.
BUCKET_ROWS = 1_000
# Questions whose exact neighbours tell how far the approximate search must look, and
# what is added to the share to find for the error of that sample.
SAMPLE_ROWS = 200
SAMPLE_ERROR = 0.02
DIGITS = 9


def _matrix(vectors: Sequence) -> np.ndarray:
    """Unit rows; a zero vector stays zero."""
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    return _unit(m)


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def _unit_rows(column: pa.Array) -> np.ndarray:
    lengths = pc.list_value_length(column)
    if column.null_count or len(pc.unique(lengths)) != 1 or not lengths[0].as_py():
        return _matrix(column.to_pylist())
    flat = column.flatten()
    if flat.null_count:
        return _matrix(column.to_pylist())
    return _unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


class _Board:
    """Best k rows per question seen so far, by rounded score; equal ones as they came."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.scores = np.full((questions, k), -np.inf)
        self.rows = np.zeros((questions, k), dtype=np.int64)
        # what a score must reach to count; a little less, as scores are rounded later
        self.bars = np.full(questions, -np.inf)
        self.keys: list[pa.Array] = []
        self.size = 0

    def add(self, keys: pa.Array) -> int:
        """The number of the first of these keys."""
        self.keys.append(keys)
        self.size += len(keys)
        return self.size - len(keys)

    def offer(self, which: np.ndarray, scores: np.ndarray, first: int) -> None:
        """``scores`` of the questions ``which`` with the rows from ``first`` on; -inf: none."""
        bars, n = self.bars[which], scores.shape[1]
        fresh = np.flatnonzero(np.isneginf(bars))
        if n > self.k and len(fresh):
            part = np.partition(scores[fresh], n - self.k, axis=1)
            bars[fresh] = part[:, n - self.k] - 10.0**-DIGITS
        hit = scores >= bars[:, None]
        if np.isneginf(bars).any():
            hit &= ~np.isneginf(scores)
        i, j = np.nonzero(hit)
        if not len(i):
            return
        at, begins, counts = np.unique(i, return_index=True, return_counts=True)
        touched, width = which[at], int(counts.max())
        found = np.full((len(at), self.k + width), -np.inf)
        rows = np.zeros(found.shape, dtype=np.int64)
        found[:, : self.k], rows[:, : self.k] = self.scores[touched], self.rows[touched]
        line = np.repeat(np.arange(len(at)), counts)
        place = self.k + np.arange(len(i)) - np.repeat(begins, counts)
        found[line, place], rows[line, place] = np.round(scores[i, j], DIGITS), first + j
        self._take(touched, found, rows)

    def _take(self, touched: np.ndarray, found: np.ndarray, rows: np.ndarray) -> None:
        bar = np.partition(found, found.shape[1] - self.k, axis=1)[:, found.shape[1] - self.k]
        more, tie = found > bar[:, None], found == bar[:, None]
        picked = more | (tie & (np.cumsum(tie, axis=1) <= (self.k - more.sum(axis=1))[:, None]))
        self.scores[touched] = found[picked].reshape(-1, self.k)
        self.rows[touched] = rows[picked].reshape(-1, self.k)
        self.bars[touched] = bar - 10.0**-DIGITS

    def ranked(self, unit: np.ndarray, whole: np.ndarray, k: int) -> "_Board":
        """The best k of the rows kept, by the scores of the whole vectors."""
        out = _Board(len(unit), min(k, self.k))
        out.keys, out.size = self.keys, self.size
        step = max(1, SCORES // (self.k * unit.shape[1]))
        for begin in range(0, len(unit), step):
            which = np.arange(begin, min(begin + step, len(unit)))
            order = np.argsort(self.rows[which], axis=1, kind="stable")
            rows = np.take_along_axis(self.rows[which], order, axis=1)
            none = np.isneginf(np.take_along_axis(self.scores[which], order, axis=1))
            scores = np.round(np.einsum("qd,qkd->qk", unit[which], whole[rows]), DIGITS)
            out._take(which, np.where(none, -np.inf, scores), rows)
        return out


@dataclass
class Lanes:
    """Parts of the vectors that a question may pass by.

    ``visits`` takes the questions of a task and gives a function from a value of
    ``column`` to the numbers of the questions that look there.  With ``decode`` (from
    rows and the value to vectors), the best ``candidates`` by the decoded vectors are
    ranked by the whole ones.
    """

    column: str
    visits: Callable[[np.ndarray], Callable[[int], np.ndarray]]
    decode: Callable[[pa.RecordBatch, int], np.ndarray] | None = None
    candidates: int = 0
    more: Sequence[str] = ()


def nearest(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    within: Sequence[str] = (),
    per: Sequence[str] = (),
    question_id: str = "question_id",
    key: str = "object_key",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    lanes: Lanes | None = None,
) -> DataFrame:
    """The k nearest vectors of every question, with ``similarity`` and ``rank``.

    ``within`` columns exist on both sides and must be equal; ``per`` columns of
    the vectors split the ranking (k per question and value).  Ties go to the
    smaller key.  With ``lanes``, a question meets only the vectors it visits, and ties of
    one task go to the first lane.

    Groups are cut into blocks of questions and runs of vectors; each block visits each
    run of its group in one task, which reads the questions first and then the run in
    shards of at most ``shard_rows`` vectors.  It holds one block, the best rows of its
    questions and SCORES scores; only scores that reach a question's kth best are looked
    at.  A vector is shuffled once per TASK_QUESTIONS questions, a question once per
    TASK_ROWS vectors.
    """
    within, per = list(within), list(per)
    lane, more = ([lanes.column], list(lanes.more)) if lanes else ([], [])
    asked = questions.select(question_id, *within, vector)
    stored = vectors.select(*within, *per, *lane, *more, key, vector)
    kinds = {f.name: f.dataType for f in [*stored.schema.fields, *asked.schema.fields]}
    pair = [*within, "__run", "__block"]
    columns = [question_id, *per, key, "similarity"]
    schema = ", ".join(
        [f"{c} {kinds[c].simpleString()}" for c in columns[:-1]] + ["similarity double"]
    )

    runs = _pieces(stored, within, max(shard_rows, TASK_ROWS), "__runs")
    blocks = _pieces(asked, within, TASK_QUESTIONS, "__blocks")
    if within:
        plan = runs.join(blocks, within)
        asked = skew_join(asked, plan, within, "inner", [question_id])
        stored = skew_join(stored, plan, within, "inner", [key])
    else:
        numbers = {"__runs": runs, "__blocks": blocks}
        asked, stored = asked.withColumns(numbers), stored.withColumns(numbers)
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    missing = lambda names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    both = (
        asked.withColumn("__block", pick(question_id, "__blocks"))
        .withColumn("__run", every_of("__runs"))
        .select(*pair, F.lit(0).alias("__side"), question_id, *missing([*per, *lane, *more, key]), vector)
    ).unionAll(
        stored.withColumn("__run", pick(key, "__runs"))
        .withColumn("__block", every_of("__blocks"))
        .select(*pair, F.lit(1).alias("__side"), *missing([question_id]), *per, *lane, *more, key, vector)
    )
    seen = [*pair, "__side", *per, *lane]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = split = board = unit = visits = buffer = None
        ids, held, whole, waiting = [], [], [], 0

        def flush() -> None:
            nonlocal waiting
            step = max(1, SCORES // max(1, waiting))
            for q in range(0, len(unit) if waiting else 0, step):
                some = np.arange(q, min(q + step, len(unit)))
                board.offer(some, buffer[some, :waiting], board.size - waiting)
            buffer[:, :waiting] = -np.inf
            waiting = 0

        def settled() -> Iterator[pa.RecordBatch]:
            if board is not None and board.size:
                if lanes:
                    flush()
                best = board
                if lanes and lanes.decode:
                    best = board.ranked(unit, np.concatenate(whole), k)
                i, j = np.nonzero(~np.isneginf(best.scores))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[0].take(pa.array(i)),
                        *[pa.array([v] * len(i), t) for v, t in zip(split, per_types)],
                        pa.concat_arrays(best.keys).take(pa.array(best.rows[i, j])),
                        pa.array(best.scores[i, j]),
                    ],
                    names=columns,
                )

        for batch in batches:
            per_types = [batch.schema.field(c).type for c in per]
            values = list(zip(*[batch.column(c).to_pylist() for c in seen]))
            bounds = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
            for begin, end in zip(bounds[:-1], bounds[1:]):
                if begin == end:
                    continue
                here, side = values[begin][: len(pair)], values[begin][len(pair)]
                rows = batch.slice(begin, end - begin)
                if here != group:
                    yield from settled()
                    group, split, board, unit, ids, held = here, None, None, None, [], []
                if side == 0:
                    ids.append(rows.column(question_id))
                    held.append(_unit_rows(rows.column(vector)))
                    continue
                if not ids:
                    continue
                if unit is None:
                    ids, unit = [pa.concat_arrays(ids)], np.concatenate(held)
                    held, everyone = [], np.arange(len(unit))
                    if lanes:
                        visits = lanes.visits(unit)
                        buffer = np.full((len(unit), max(1, min(BUFFER, 10 * SCORES // len(unit)))), -np.inf)
                mine, at = values[begin][len(pair) + 1 :][: len(per)], values[begin][-1]
                if board is None or mine != split:
                    yield from settled()
                    keep = lanes.candidates if lanes and lanes.decode else k
                    split, board, whole = mine, _Board(len(unit), keep), []
                which = visits(at) if lanes else everyone
                low = 0
                while low < len(rows) and len(which):
                    shard = rows.slice(low, min(shard_rows, buffer.shape[1] - waiting) if lanes else shard_rows)
                    low += len(shard)
                    theirs = _unit_rows(shard.column(vector))
                    first = board.add(shard.column(key))
                    if lanes and lanes.decode:
                        whole.append(theirs)
                        theirs = lanes.decode(shard, at)
                    step = max(1, SCORES // len(theirs))
                    for q in range(0, len(which), step):
                        some = which[q : q + step]
                        scores = unit[some] @ theirs.T
                        if lanes:
                            buffer[some, waiting : waiting + len(theirs)] = scores
                        else:
                            board.offer(some, scores, first)
                    if lanes:
                        waiting += len(theirs)
                        if waiting == buffer.shape[1]:
                            flush()
        yield from settled()

    candidates = both.repartition(*pair).sortWithinPartitions(*seen, key).mapInArrow(score, schema)
    return top_rows(
        candidates, [question_id, *per], [F.col("similarity").desc(), F.col(key)], k
    )


def _pieces(df: DataFrame, within: list[str], rows: int, name: str) -> DataFrame | Column:
    """Number of pieces of about ``rows`` rows: per group, or one number for all."""
    size = F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name)
    return df.groupBy(*within).agg(size) if within else df.agg(size).scalar()


def top_per_type(
    questions: DataFrame,
    vectors: DataFrame,
    limits: Mapping[str, int],
    within: Sequence[str] = ("database_id",),
    kind: str = "object_type",
    others: int = 0,
    **names: str,
) -> DataFrame:
    """Different k per object type, from one scan of the vectors; types without a limit
    of their own have ``others``."""
    wanted = vectors if others else vectors.filter(F.col(kind).isin(list(limits)))
    most = max([others, *limits.values()])
    hits = nearest(questions, wanted, most, within, [kind], **names)
    allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    limit = F.coalesce(F.try_element_at(allowed, F.col(kind)), F.lit(others))
    return hits.filter(F.col("rank") <= limit)


def search(
    vectors: DataFrame,
    query: Sequence[float],
    object_type: str | None = None,
    k: int = 10,
    **names: str,
) -> DataFrame:
    """One query vector, optionally over one object type."""
    if object_type is not None:
        vectors = vectors.filter(F.col("object_type") == object_type)
    one = vectors.sparkSession.createDataFrame(
        [(0, [float(x) for x in query])],
        f"question_id int, {names.get('vector', 'embedding')} array<double>",
    )
    return nearest(one, vectors, k, **names).drop("question_id")


# ------------------------------------------------------------------- approximate


def plane(i: int, dimensions: int, seed: int = 7) -> list[float]:
    """A random direction, the same on every executor and in every run."""
    return np.random.default_rng([seed, i]).standard_normal(dimensions).tolist()


def nearest_approximate(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    dimensions: int,
    planes: int | None = None,
    probes: int | None = None,
    share: float = 0.9,
    question_id: str = "question_id",
    key: str = "object_key",
    vector: str = "embedding",
    **options: int,
) -> DataFrame:
    """Search only buckets of similar direction, then rank exactly inside them.

    A bucket is the side taken of ``planes`` random planes; without a number given, as
    many as make buckets of about BUCKET_ROWS vectors.  A question looks in the buckets
    whose flipped planes are nearest to it, up to a distance that is measured: far enough
    to find ``share`` of the exact neighbours of SAMPLE_ROWS questions, at any number of
    planes.  Where neighbours are spread over most buckets, most are visited.  With
    ``probes`` given, it looks in its own bucket and, with 1, in those one plane away.
    """
    if planes is None:
        planes = max(1, round(math.log2(max(2, vectors.count() / BUCKET_ROWS))))
    normals = [plane(i, dimensions) for i in range(planes)]

    def bucket(df: DataFrame) -> DataFrame:
        code = F.lit(0)
        for i in range(planes):
            normal = F.array(*[F.lit(x) for x in normals[i]])
            side = F.aggregate(
                F.zip_with(F.col(vector), normal, lambda a, b: a.cast("double") * b),
                F.lit(0.0),
                lambda acc, x: acc + x,
            )
            code = code + F.when(side >= 0, F.lit(1 << i)).otherwise(F.lit(0))
        return df.withColumn("bucket", code)

    normal = np.array(normals)
    radius = 0.0
    if probes is None:
        radius = _probe_radius(questions, vectors, k, normal, share, question_id, key, vector)

    def visits(unit: np.ndarray) -> Callable[[int], np.ndarray]:
        sides = unit @ normal.T

        def looking(code: int) -> np.ndarray:
            other = (sides >= 0) != ((code >> np.arange(planes)) & 1).astype(bool)
            if probes is not None:
                return np.flatnonzero(other.sum(axis=1) <= min(probes, 1))
            return np.flatnonzero(np.where(other, sides * sides, 0.0).sum(axis=1) <= radius)

        return looking

    return nearest(
        questions, bucket(vectors.select(key, vector)), k, (), (), question_id, key, vector,
        lanes=Lanes("bucket", visits), **options,
    )


def _probe_radius(
    questions: DataFrame, vectors: DataFrame, k: int, normals: np.ndarray, share: float,
    question_id: str, key: str, vector: str,
) -> float:
    """Squared distance to flipped planes within which ``share`` of true neighbours lie."""
    some = questions.select(question_id, vector).orderBy(F.xxhash64(question_id), question_id)
    some = some.limit(SAMPLE_ROWS).toPandas()
    if some.empty:
        return 0.0
    kinds = questions.select(question_id, vector).schema
    asked = questions.sparkSession.createDataFrame(
        list(zip(some[question_id].tolist(), [np.asarray(v).tolist() for v in some[vector]])), kinds
    )
    hits = nearest(asked, vectors.select(key, vector), k, (), (), question_id, key, vector)
    pairs = vectors.select(key, vector).join(F.broadcast(hits), key).select(question_id, vector)
    found = pairs.toPandas()
    if found.empty:
        return 0.0
    sides = dict(zip(some[question_id].tolist(), _matrix(some[vector].tolist()) @ normals.T))
    mine = np.array([sides[q] for q in found[question_id].tolist()])
    theirs = _matrix(found[vector].tolist()) @ normals.T
    apart = np.where((mine >= 0) != (theirs >= 0), mine * mine, 0.0).sum(axis=1)
    wanted = min(1.0, share + SAMPLE_ERROR)
    return float(np.quantile(apart, wanted, method="higher")) + 1e-9


def recall(exact: DataFrame, approximate: DataFrame, question_id: str, key: str) -> DataFrame:
    """Share of exact neighbours that the approximate search found."""
    found = approximate.select(question_id, key, F.lit(1).alias("hit"))
    return exact.join(found, [question_id, key], "left").agg(
        F.count(F.lit(1)).alias("exact_pairs"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("found_pairs"),
        F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"),
    )
