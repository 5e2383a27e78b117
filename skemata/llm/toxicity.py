"""Toxicity: a convolutional text classifier, trained in numpy, run in Spark tasks.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings
of three to eight bytes, so that unseen endings of a seen stem count.  Filters of
several widths slide over the embedded words, each filter's highest response in the
text is kept, and a logistic layer scores these maxima.  The score is calibrated to
a probability on labelled rows the network did not learn from; on the same rows a
threshold is chosen for each language.  Language, id, source and label never enter a
score.

Training reads every labelled row of any length.  A first task passes over the rows of a
hashed draw of about ``FIRST`` until the network has taken shape; then all rows are dealt
to tasks of about ``SHARE`` rows, each of which goes on from that network, and the changes
are averaged, those of a word's embedding over the tasks that met the word.  Calibration
reads every labelled row of another quarter: logits are counted by language, label and
hundredths, so no more than the counts reach the driver.  A language with fewer than
``POSITIVES`` positives among them keeps the general threshold.
Scoring covers every word of every text, in blocks.

Defined cases: null and empty texts have no response and get the score of that;
without labelled rows of both classes every score is 0; labels other than 0 and 1
are ignored, a document labelled twice counts twice; repeated texts get equal
scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import held_out, remainder, written
from skemata.llm.wordhash import byte_view, span_hashes, text_slices, word_spans

BITS = 15
DIMS = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
BEGINNINGS = (3, 4, 5, 6, 8)
THRESHOLD = 0.3
BLOCK_WORDS = 1 << 15
BATCH = 16
WORD_DROPOUT = 0.3
# positives a language needs for a threshold of its own
POSITIVES = 20
# rows of the first task, rows of each later one, embedding rows sent together
FIRST = 8192
SHARE = 8192
SENT = 512
# bins of a logit, per unit
BINS = 100

# bytes that words do not hold: all ASCII but letters and digits
_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 1 + len(BEGINNINGS)) embedding rows of each word, and text offsets."""
    data, offsets = byte_view(texts)
    starts, ends = word_spans(data, offsets, _GAPS)
    hashes = [span_hashes(data, starts, ends, True)]
    for size in BEGINNINGS:
        hashes.append(span_hashes(data, starts, np.minimum(starts + size, ends), True))
    out = np.empty((len(starts), len(hashes)), dtype=np.int32)
    for k, h in enumerate(hashes):
        with np.errstate(over="ignore"):
            out[:, k] = ((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return out, np.searchsorted(starts, offsets)


@dataclass
class Network:
    embeddings: np.ndarray
    filters: np.ndarray  # (DIMS, sum of widths, FILTERS)
    filter_bias: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, slots: np.ndarray) -> list[np.ndarray]:
        """Per width the filter responses at every place of one stretch of words."""
        vectors = self.embeddings[slots[:, 0]]
        for k in range(1, slots.shape[1]):
            vectors += self.embeddings[slots[:, k]]
        spread = (vectors @ self.filters.reshape(DIMS, -1)).reshape(
            len(slots), sum(WIDTHS), FILTERS
        )
        found, at = [], 0
        for w, width in enumerate(WIDTHS):
            n = len(slots) - width + 1
            if n > 0:
                total = spread[:n, at] + self.filter_bias[w]
                for d in range(1, width):
                    total += spread[d : d + n, at + d]
                found.append(total)
            else:
                found.append(np.empty((0, FILTERS), dtype=np.float32))
            at += width
        return found

    def pooled(self, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Maxima per text; at least 0 (a rectifier), which is what an empty text has."""
        out = np.zeros((len(offsets) - 1, len(WIDTHS), FILTERS), dtype=np.float32)
        first = 0
        while first < len(out):
            # texts together up to a block; a longer text alone, in overlapping stretches
            last = max(
                first + 1,
                int(np.searchsorted(offsets, offsets[first] + BLOCK_WORDS, side="right")) - 1,
            )
            begin, end = int(offsets[first]), int(offsets[last])
            for at in range(begin, max(end, begin + 1), BLOCK_WORDS):
                stretch = slots[at : min(end, at + BLOCK_WORDS + max(WIDTHS) - 1)]
                bounds = np.clip(offsets[first : last + 1] - at, 0, len(stretch))
                for w, found in enumerate(self.responses(stretch)):
                    low = bounds[:-1]
                    high = np.maximum(bounds[1:] - WIDTHS[w] + 1, low)
                    some = np.flatnonzero(high > low)
                    if len(some):
                        # places that reach into the next text are left out
                        cuts = np.column_stack([low[some], high[some]]).ravel()
                        padded = np.vstack([found, np.zeros((1, FILTERS), np.float32)])
                        best = np.maximum.reduceat(padded, cuts, axis=0)[::2]
                        rows = first + some
                        out[rows, w] = np.maximum(out[rows, w], best)
            first = last
        return out

    def peaks(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of one text, at least 0, and the places they are at."""
        pooled = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        places = np.zeros((len(WIDTHS), FILTERS), dtype=np.int64)
        for at in range(0, len(slots), BLOCK_WORDS):
            stretch = slots[at : at + BLOCK_WORDS + max(WIDTHS) - 1]
            for w, found in enumerate(self.responses(stretch)):
                if len(found):
                    best = found.argmax(axis=0)
                    values = found[best, np.arange(FILTERS)]
                    higher = values > pooled[w]
                    pooled[w, higher] = values[higher]
                    places[w, higher] = at + best[higher]
        return pooled, places

    def logits(self, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        pooled = self.pooled(slots, offsets).reshape(len(offsets) - 1, -1)
        return pooled @ self.out + self.bias

    def scores(self, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.slope * self.logits(slots, offsets).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _adagrad(value: np.ndarray, seen: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    seen += gradient * gradient
    value -= rate * gradient / np.sqrt(seen)


def fresh(seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        (rng.standard_normal((1 << BITS, DIMS)) * 0.05).astype(np.float32),
        (rng.standard_normal((DIMS, sum(WIDTHS), FILTERS)) * 0.3).astype(np.float32),
        np.zeros((len(WIDTHS), FILTERS), dtype=np.float32),
        (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
        0.0,
    )


def flat(net: Network) -> np.ndarray:
    """All weights as rows of ``DIMS``: the embeddings, then the other layers."""
    rest = np.concatenate([net.filters.ravel(), net.filter_bias.ravel(), net.out, [net.bias]])
    rest = np.pad(rest.astype(np.float32), (0, -len(rest) % DIMS))
    return np.vstack([net.embeddings, rest.reshape(-1, DIMS)])


def unflat(weights: np.ndarray) -> Network:
    sizes = [DIMS * sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS, 1]
    filters, filter_bias, out, bias, _ = np.split(weights[1 << BITS :].ravel(), np.cumsum(sizes))
    return Network(
        weights[: 1 << BITS].copy(),
        filters.reshape(DIMS, sum(WIDTHS), FILTERS).copy(),
        filter_bias.reshape(len(WIDTHS), FILTERS).copy(),
        out.copy(),
        float(bias[0]),
    )


class Trainer:
    """Adagrad on a network, batch by batch; ``shares``: how much a text of class 0 and one
    of class 1 count."""

    def __init__(
        self,
        net: Network,
        shares: tuple[float, float],
        seen: Network | None = None,
        rate: float = 0.1,
        seed: int | list[int] = 3,
    ):
        self.net, self.shares, self.rate = net, shares, rate
        self.rng = np.random.default_rng(seed)
        self.seen = seen or unflat(np.full_like(flat(net), 0.1))
        self.starts = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        net, seen, rate = self.net, self.seen, self.rate
        grad_f, grad_b = np.zeros_like(net.filters), np.zeros_like(net.filter_bias)
        grad_o, grad_c = np.zeros_like(net.out), 0.0
        slots_hit, grads_hit = [], []
        for text, label in zip(texts, labels):
            # words left out at random: a text's other toxic words get learned, too
            slots = text[self.rng.random(len(text)) >= WORD_DROPOUT]
            pooled, places = net.peaks(slots)
            z = float(pooled.ravel() @ net.out) + net.bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
            error *= self.shares[int(label)] / len(texts)
            grad_o += np.float32(error) * pooled.ravel()
            grad_c += error
            back = np.float32(error) * net.out.reshape(len(WIDTHS), FILTERS) * (pooled > 0)
            grad_b += back
            for w, width in enumerate(WIDTHS):
                live = np.flatnonzero(back[w])
                for d in range(width if len(live) else 0):
                    at = self.starts[w] + d
                    hit = slots[places[w, live] + d]  # (live, kinds)
                    vectors = net.embeddings[hit].sum(axis=1)  # (live, DIMS)
                    grad_f[:, at, live] += (vectors * back[w, live, None]).T
                    to_words = (net.filters[:, at, live] * back[w, live]).T
                    slots_hit.append(hit.ravel())
                    grads_hit.append(np.repeat(to_words, hit.shape[1], axis=0))
        _adagrad(net.filters, seen.filters, grad_f + 1e-5 * net.filters, rate)
        _adagrad(net.filter_bias, seen.filter_bias, grad_b, rate)
        _adagrad(net.out, seen.out, grad_o + 1e-5 * net.out, rate)
        seen.bias += grad_c**2
        net.bias -= float(rate * grad_c / np.sqrt(seen.bias))
        if slots_hit:
            rows, where = np.unique(np.concatenate(slots_hit), return_inverse=True)
            total = np.zeros((len(rows), DIMS), dtype=np.float32)
            np.add.at(total, where, np.concatenate(grads_hit))
            seen.embeddings[rows] += total * total
            net.embeddings[rows] -= rate * total / np.sqrt(seen.embeddings[rows])


def passes_for(rows: int, steps: int, later: int = 0) -> int:
    """Few texts are passed over more often, so that about ``steps`` steps are made in any
    case; ``later``: rows that are passed over once after them."""
    return min(60, max(2 if later else 1, -(-(steps * BATCH - later) // max(1, rows))))


def class_shares(negatives: int, positives: int) -> tuple[float, float]:
    """Both classes count alike, however many rows they have."""
    total = negatives + positives
    return 0.5 * total / max(negatives, 1e-9), 0.5 * total / max(positives, 1e-9)


def train(
    texts: list[np.ndarray], labels: np.ndarray, steps: int = 1800, rate: float = 0.1, seed: int = 3
) -> Network:
    """``texts``: the word slots of each text, all in memory; ``learn`` is for tables."""
    positives = int((labels == 1).sum())
    trainer = Trainer(
        fresh(seed), class_shares(len(labels) - positives, positives), rate=rate, seed=seed
    )
    for _ in range(passes_for(len(texts), steps)):
        order = trainer.rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            trainer.step([texts[i] for i in batch], labels[batch])
    return trainer.net


def train_task(trainer: Trainer, batches: Iterator[pa.RecordBatch]) -> int:
    """One pass over a task's rows (label, text) as they come; how many there were."""
    texts, labels, n = [], [], 0
    for part in text_slices(batches, 1, 1 << 20):
        words, offsets = word_slots(part.column(1))
        for i, label in enumerate(part.column(0).to_pylist()):
            texts.append(words[offsets[i] : offsets[i + 1]])
            labels.append(label)
            if len(texts) == BATCH:
                trainer.step(texts, labels)
                texts, labels = [], []
        n += part.num_rows
    if texts:
        trainer.step(texts, labels)
    return n


def calibrate(
    net: Network,
    logits: np.ndarray,
    labels: np.ndarray,
    langs: list,
    weights: np.ndarray | None = None,
) -> None:
    """Platt scaling of the score, then a threshold per language; ``weights``: how many
    labelled rows each row stands for."""
    w = np.ones(len(labels)) if weights is None else weights.astype(np.float64)
    z = np.clip(logits.astype(np.float64), -60, 60)
    # targets kept off 0 and 1 by the class sizes, so that a clean split has a finite slope
    pos, neg = w[labels == 1].sum(), w[labels == 0].sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        y = np.clip(a * z + b, -60, 60)
        return (w * (np.logaddexp(0, y) - target * y)).sum() + 5e-4 * (a - 1) ** 2

    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on two parameters, shortened until they lead down
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        e, s = w * (p - target), w * p * (1 - p)
        g = np.array([(e * z).sum() + 1e-3 * (a - 1), e.sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while loss(a - step[0], b - step[1]) > now and np.abs(step).max() >= 1e-6:
            step = step / 2
        if np.abs(step).max() < 1e-6:
            break
        a, b = a - step[0], b - step[1]
    net.slope, net.shift = float(max(a, 1e-3)), float(b)
    scores = 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -60, 60)))
    names = np.array([str(x) for x in langs], dtype=object)
    for name in set(names[[x is not None for x in langs]]):
        mine = names == name
        if w[mine][labels[mine] == 1].sum() < POSITIVES:
            continue
        # best F1; ties and few cases pull towards the general threshold
        grid = np.round(np.arange(0.05, 0.96, 0.05), 2)
        f1 = []
        for t in grid:
            hit = scores[mine] >= t
            right = w[mine][hit & (labels[mine] == 1)].sum()
            f1.append(2 * right / (w[mine][hit].sum() + w[mine][labels[mine] == 1].sum()))
        best = np.flatnonzero(np.array(f1) >= max(f1) - 0.002)
        net.thresholds[name] = float(grid[best[np.argmin(np.abs(grid[best] - THRESHOLD))]])


def trained(rows: DataFrame, known: DataFrame, steps: int) -> Network | None:
    """A network that has learned from all ``rows`` (__id, text, lang) that are labelled;
    None if one of the classes has none."""
    found = rows.select("__id").join(known, "__id").groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in found}
    if len(counts) < 2:
        return None
    shares = class_shares(counts[0], counts[1])
    total = sum(counts.values())
    bound = int(min(1.0, FIRST / total) * (1 << 30))
    draw = F.pmod(F.xxhash64(F.lit(23), "__id"), F.lit(1 << 30))
    texts = rows.select("__id", "text")
    start = fresh()
    context = rows.sparkSession.sparkContext
    passes = passes_for(min(total, FIRST), steps, total if total > FIRST else 0)

    def ordered(labelled: DataFrame) -> DataFrame:
        # rows come in a hashed order, so that equal tables give equal networks
        by = F.xxhash64(F.lit(29), "pass", "__id", "text")
        return labelled.sortWithinPartitions("pass", by, "label").select("label", "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(start, shares)
        if train_task(trainer, batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([flat(x).tobytes()], pa.binary()) for x in (trainer.net, trainer.seen)],
                names=["net", "seen"],
            )

    early = texts.filter(draw < bound).join(known.filter(draw < bound), "__id")
    early = early.repartition(1).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    made = ordered(early).mapInArrow(first, "net binary, seen binary").collect()
    shaped = [np.frombuffer(x, np.float32).reshape(-1, DIMS) for r in made for x in r]
    if not shaped:  # few rows, none of them drawn
        shaped = [flat(start), np.full_like(flat(start), 0.1)]
    if bound == 1 << 30:
        return unflat(shaped[0])

    shared = context.broadcast(shaped)
    tasks = -(-total // SHARE)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = shared.value
        trainer = Trainer(unflat(before), shares, unflat(seen), seed=[5, TaskContext.get().partitionId()])
        n = train_task(trainer, batches)
        change = (flat(trainer.net) - before).astype(np.float32)
        met = (change != 0).any(axis=1)
        met[1 << BITS :] = True
        for block in range(0, len(change) if n else 0, SENT):
            at = block + np.flatnonzero(met[block : block + SENT])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()),
                        pa.array([n], pa.int64()),
                        pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([change[at].tobytes()], pa.binary()),
                    ],
                    names=["block", "n", "at", "change"],
                )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, block = np.zeros((SENT, DIMS)), np.zeros((SENT, 1)), 0
        for batch in batches:
            for row in batch.to_pylist():
                block = row["block"]
                at = np.frombuffer(row["at"], np.int32) - block
                total[at] += row["n"] * np.frombuffer(row["change"], np.float32).reshape(-1, DIMS)
                weight[at] += row["n"]
        mean = (total / np.maximum(weight, 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())],
            names=["block", "mean"],
        )

    # by id, so that a task's rows are mixed however the table is ordered
    dealt = texts.repartition(tasks, "__id").join(known.repartition(tasks, "__id"), "__id")
    dealt = dealt.coalesce(tasks).withColumn("pass", F.lit(1))
    changes = ordered(dealt).mapInArrow(later, "block int, n long, at binary, change binary")
    weights = shaped[0].copy()
    # as many rows as the network has blocks, whatever the number of tasks
    for r in changes.groupBy("block").applyInArrow(average, "block int, mean binary").collect():
        mine = weights[r["block"] : r["block"] + SENT]
        mine += np.frombuffer(r["mean"], np.float32).reshape(-1, DIMS)[: len(mine)]
    return unflat(weights)


def counted_logits(rows: DataFrame, known: DataFrame, net: Network) -> DataFrame:
    """``lang, label, bin, n``: the labelled ``rows`` by hundredths of their logit.
    Languages with fewer than ``POSITIVES`` positives are counted together as null."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, 1 << 20):
            z = np.clip(shared.value.logits(*word_slots(part.column(1))), -60, 60)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.rint(z * BINS).astype(np.int32))],
                names=["__id", "lang", "bin"],
            )

    slim = rows.select("__id", "text", "lang")
    slim = slim.mapInArrow(bins, slim.select("__id", "lang").schema.add("bin", "integer"))
    counts = slim.join(known, "__id").groupBy("lang", "label", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "toxic-logits")
    large = counts.filter("label = 1 and lang is not null").groupBy("lang").agg(F.sum("n").alias("positives"))
    large = large.filter(F.col("positives") >= POSITIVES).select("lang", F.col("lang").alias("own"))
    return (
        counts.join(large, "lang", "left")
        .groupBy(F.col("own").alias("lang"), "label", "bin")
        .agg(F.sum("n").alias("n"))
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    label: str = "toxic",
    calibration: int | None = None,
    max_words: int | None = None,
    steps: int = 1800,
) -> Network | None:
    """None if one of the classes has no labelled row to learn from.

    ``calibration`` and ``max_words`` once bounded the rows and texts that were read; they
    have no effect any more: all labelled rows are read, whole."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label"))
    known = known.filter("label in (0, 1)")
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"),
    )
    net = trained(rows.filter(remainder("__id").isin(0, 3)), known, steps)
    if net is None:
        return None
    # at most a row per label and bin, and per language with positives enough
    checked = counted_logits(rows.filter(remainder("__id") == 1), known, net).toPandas()
    if checked["label"].nunique() == 2:
        checked["lang"] = checked["lang"].astype(object).where(checked["lang"].notna(), None)
        checked = checked.sort_values(["label", "bin", "lang"], kind="stable")
        calibrate(
            net,
            checked["bin"].to_numpy() / BINS,
            checked["label"].to_numpy(dtype=np.int64),
            checked["lang"].tolist(),
            checked["n"].to_numpy(),
        )
    return net


def score_texts(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` (id columns and the text) with ``score``."""
    if net is None:
        return docs.drop(text).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c != text]
    names = [docs.columns[i] for i in kept]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(batches, at, 1 << 20):
            scores = known.scores(*word_slots(part.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in kept], pa.array(scores, pa.float64())],
                names=[*names, "score"],
            )

    return docs.mapInArrow(rows, docs.drop(text).schema.add("score", "double"))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    **sizes: int,
) -> DataFrame:
    """``id, held_out, score, predicted, rejected``: ``predicted`` by the general
    threshold, ``rejected`` by that of the row's language."""
    net = learn(docs, labels, id_col, text, lang, **sizes)
    rows = docs.select(
        F.col(id_col),
        held_out(id_col).alias("held_out"),
        (F.col(lang) if lang else F.lit(None).cast("string")).alias("__lang"),
        F.col(text),
    )
    limit = F.lit(THRESHOLD)
    if net and net.thresholds:
        own = F.create_map(*[F.lit(x) for pair in sorted(net.thresholds.items()) for x in pair])
        limit = F.coalesce(own[F.col("__lang")], limit)
    return score_texts(rows, net, text).select(
        id_col,
        "held_out",
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= limit).alias("rejected"),
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    **sizes: int,
) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold of their language."""
    net = learn(docs, labels, id_col, text, lang, **sizes)
    if net is None:
        return docs
    at = docs.columns.index(text)
    lang_at = docs.columns.index(lang) if lang else None
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(batches, at, 1 << 20):
            scores = known.scores(*word_slots(part.column(at)))
            langs = [None] * len(scores) if lang_at is None else part.column(lang_at).to_pylist()
            limits = np.array([known.thresholds.get(x, THRESHOLD) for x in langs])
            yield part.filter(pa.array(scores < limits))

    return docs.mapInArrow(rows, docs.schema)
