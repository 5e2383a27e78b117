"""Language ID by hierarchical discrimination.

A linear SVM per family against the rest picks the language family; within it,
one-versus-one linear SVMs between each two of its languages vote, and the sum
of their margins breaks ties.  Features are hashed byte n-grams of the whole text,
as square roots of their counts, scaled to length one.  The SVMs are trained in
numpy by dual coordinate descent on a bounded sample: at most ``per_language``
documents of each of the ``max_languages`` most frequent languages.

Defined cases: a null text, or one without letters, is ``und`` with score 0; rows
with null language are not learned from; without any labelled row every text is
``und``; ids do not enter a prediction, so repeated texts get equal results; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import held_out, keyed, per_group_sample, remainder
from skemata.llm.wordhash import byte_view, text_slices

BITS = 14
ORDERS = (2, 3, 4)
# Closely related languages by ISO 639-1 code; others stand alone.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Scaled feature vector of each text."""
    folded = _FOLD[data]
    slots = []
    gram = folded
    with np.errstate(over="ignore"):
        for order in range(2, max(ORDERS) + 1):
            gram = gram[:-1] * np.uint32(0x01000193) + folded[order - 1 :]
            if order in ORDERS:
                slots.append(
                    ((gram * np.uint32(0x9E3779B1) + np.uint32(order)) * np.uint32(0x85EBCA6B))
                    >> np.uint32(32 - BITS)
                )
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        x = np.zeros(1 << BITS, dtype=np.float32)
        for order, slot in zip(ORDERS, slots, strict=True):
            if end - begin >= order:
                x += np.bincount(slot[begin : end - order + 1], minlength=1 << BITS)
        np.sqrt(x, out=x)
        length = float(np.sqrt(x @ x))
        yield x / length if length else x


@dataclass
class Svm:
    """w, b with sign(w x + b), and the slope that makes a margin a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights @ x) + self.bias


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, passes: int = 12, seed: int = 5) -> Svm:
    """L2-regularised squared-hinge SVM by dual coordinate descent (y is +1 or -1)."""
    rng = np.random.default_rng(seed)
    n = len(y)
    weights, bias = np.zeros(x.shape[1], dtype=np.float32), 0.0
    alpha = np.zeros(n)
    # the rarer side counts more, so that it is not argued away
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    ridge = share / cost
    norms = np.einsum("ij,ij->i", x, x) + 1.0
    for _ in range(passes):
        for i in rng.permutation(n):
            gradient = y[i] * (float(weights @ x[i]) + bias) - 1 + ridge[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (norms[i] + ridge[i]))
            if new != alpha[i]:
                step = float(new - alpha[i]) * y[i]
                weights += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    margins = (x @ weights + bias) * y
    slopes = np.array([1.0, 2.0, 4.0, 8.0])
    losses = [np.log1p(np.exp(-np.clip(s * margins, -50, 50))).mean() for s in slopes]
    return Svm(weights, bias, float(slopes[int(np.argmin(losses))]))


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    outer: list[Svm] = field(default_factory=list)
    inner: dict[tuple[str, str], Svm] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return "und", 0.0
        family, sure = self.families[0], 1.0
        if self.outer:
            odds = _sigmoid(np.array([s.slope * s.margin(x) for s in self.outer]))
            best = int(np.argmax(odds))
            family, sure = self.families[best], float(odds[best])
        names = self.languages[family]
        votes = dict.fromkeys(names, 0)
        margins = dict.fromkeys(names, 0.0)
        odds_of: dict[str, list[float]] = {n: [] for n in names}
        for a, b in combinations(names, 2):
            svm = self.inner[a, b]
            margin = svm.margin(x)
            votes[a if margin >= 0 else b] += 1
            margins[a] += margin
            margins[b] -= margin
            p = float(_sigmoid(np.array(svm.slope * margin)))
            odds_of[a].append(p)
            odds_of[b].append(1 - p)
        best_name = max(names, key=lambda n: (votes[n], margins[n], n))
        return best_name, sure * (float(np.mean(odds_of[best_name])) if odds_of[best_name] else 1.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, labels: list[str]) -> LanguageModel:
    """``x``: one feature row per label."""
    model = LanguageModel()
    labels = np.array(labels, dtype=object)
    for name in sorted(set(labels)):
        model.languages.setdefault(FAMILY_OF.get(name, name), []).append(name)
    model.families = sorted(model.languages)
    kin = np.array([FAMILY_OF.get(n, n) for n in labels], dtype=object)
    if len(model.families) > 1:
        model.outer = [train_svm(x, np.where(kin == f, 1, -1)) for f in model.families]
    for names in model.languages.values():
        for a, b in combinations(names, 2):
            both = (labels == a) | (labels == b)
            model.inner[a, b] = train_svm(x[both], np.where(labels[both] == a, 1, -1))
    return model


def learn(
    docs: DataFrame,
    id_col: str,
    text: str,
    lang: str,
    per_language: int = 400,
    max_languages: int = 100,
) -> LanguageModel:
    """Trains on a bounded sample of rows with a language that are not held out."""
    labelled = keyed(
        docs.select(F.col(id_col), F.col(text).alias("text"), F.col(lang).alias("lang"))
        .filter((remainder(id_col) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()),
        F.col("text"),
        F.col(id_col),
    )
    sample = per_group_sample(labelled, "lang", per_language, max_languages, seed=11)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, 1 << 20):
            slots, values = [], []
            for x in ngram_counts(*byte_view(part.column(1))):
                some = np.flatnonzero(x)
                slots.append(some.astype(np.int32).tobytes())
                values.append(x[some].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                names=["lang", "slots", "features"],
            )

    rows = (
        sample.select("lang", "text", "__k1", "__k2")
        .mapInArrow(features, "lang string, slots binary, features binary")
        .toPandas()
        .sort_values(["lang", "slots", "features"], kind="stable")
    )
    x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for i, (slots, values) in enumerate(zip(rows["slots"], rows["features"], strict=True)):
        x[i, np.frombuffer(slots, dtype=np.int32)] = np.frombuffer(values, dtype=np.float32)
    return fit(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` (id columns and the text) with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    places = [i for i in range(len(docs.columns)) if i != at]
    kept = [docs.columns[i] for i in places]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(batches, at, 1 << 20):
            names, scores = [], []
            texts = part.column(at).to_pylist()
            for value, x in zip(texts, ngram_counts(*byte_view(part.column(at))), strict=True):
                found = ("und", 0.0)
                if value and LETTER.search(value):
                    found = known.predict(x)
                names.append(found[0])
                scores.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i) for i in places],
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=[*kept, "lang_pred", "score"],
            )

    schema = docs.drop(text).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(rows, schema)


def predict_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    max_languages: int = 100,
) -> DataFrame:
    """``id, held_out, lang_pred, score`` for every row."""
    model = learn(docs, id_col, text, lang, per_language, max_languages)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text))
    return identify(rows, model, text)
