"""Language ID, toxicity, quality rules: held-out accuracy and plain Python counts."""

import random

import numpy as np
import pytest
from helpers import awkward, frame, words
from pyspark.sql import functions as F

from skemata.llm import language, quality_rules, toxicity
from skemata.llm.common import held_out, per_group_sample, keyed

SYLLABLES = {
    "en": "the and ing tion th er on at wh sh".split(),
    "de": "der ung sch ein keit ß ü ver ge ich".split(),
    "nl": "het een ij oe aa heid ge van oo sch".split(),
    "fr": "le eau oi é que ai tion des eux ç".split(),
    "es": "el ción ñ que as os rr ll mente í".split(),
}


def invented(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    rows = [(i, invented(lang, i), lang, "s", 1) for i in range(400) for lang in [list(SYLLABLES)[i % 5]]]
    rows += awkward() + [(9000, "123 456 !?", "en", "s", 1), (9001, invented("fr", 1), None, "s", 1)]
    docs = frame(spark, rows, ["lang_pred", "slots"])
    got = language.predict_languages(docs, per_language=50)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert got.count() == len(rows)
    tested = [r for r in rows if r[0] is not None and r[0] < 400 and r[0] > 8 and found[r[0]].held_out]
    assert len(tested) > 60
    right = sum(found[r[0]].lang_pred == r[2] for r in tested)
    assert right >= 0.97 * len(tested)
    for i in (1, 2, 3, 9000):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[9001].lang_pred == "fr"


def test_language_without_labels(spark):
    docs = frame(spark, [(i, "some text", None, "s", 1) for i in range(5)])
    assert {r.lang_pred for r in language.predict_languages(docs).collect()} == {"und"}
    assert language.predict_languages(frame(spark, [])).count() == 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 30)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    svm = language.train_svm(x, y)
    assert np.mean(np.sign(x @ svm.weights + svm.bias) == y) > 0.97


def toxic_rows(n):
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        r = random.Random(i)
        text = invented(lang, i, r.randrange(20, 120)).split(" ")
        toxic = int(i % 4 == 0)
        if toxic:
            stem = "zorgl" if lang == "en" else "brofni"
            for _ in range(2):
                text.insert(r.randrange(len(text)), stem + r.choice(["", "s", "ing", "eau", "xy"]) + ",")
        rows.append((i, " ".join(text), lang, "s", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(1200)
    extra = [(5000 + i,) + r[1:] for i, r in enumerate(awkward())]
    docs = frame(spark, rows + extra, ["score", "part"])
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, table, steps=1500)
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) + len(extra)
    tested = [i for i, _, _ in labels if found[i].held_out]
    truth = {i: t for i, _, t in labels}
    assert sum(found[i].predicted == truth[i] for i in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    left = toxicity.drop_toxic(docs, table, steps=1500)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert ids == {i for i, r in found.items() if not r.rejected}


def test_toxicity_without_labels(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    rows, labels = toxic_rows(60)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(frame(spark, []), table, steps=5).count() == 0


def test_every_language_with_positives_gets_a_threshold(spark):
    """A small language, all of whose texts are longer than those learned from."""
    rows, labels = [], []
    for i in range(1400):
        lang = "es" if i % 7 == 0 else "en"
        toxic = int(i % 2 == 0)
        text = invented(lang, i, 250 if lang == "es" else 30) + (" zorgl" if toxic else "")
        rows.append((i, text, lang, "s", 1))
        labels.append((i, 1, toxic))
    rows += [(2000 + i, invented("fr", i, 30), None, "s", 1) for i in range(40)]
    labels += [(2000 + i, 1, i % 2) for i in range(40)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.learn(frame(spark, rows), table, calibration=60, max_words=200, steps=40)
    assert set(net.thresholds) == {"en", "es"}


def test_all_labelled_rows_are_learned_from_in_tasks(spark, monkeypatch):
    """One sign of toxicity stands only in texts beyond 3,000 words; tasks are small."""
    monkeypatch.setattr(toxicity, "FIRST", 100)
    monkeypatch.setattr(toxicity, "SHARE", 100)
    rows, labels = [], []
    for i in range(600):
        toxic, long = i % 2, i % 4 >= 2
        text = invented("en", i % 40, 3050 if long else 30) + (" krumpf" if long else " zorgl") * toxic
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, toxic))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(frame(spark, rows), table, steps=150).collect()
    tested = [r for r in got if r.held_out]
    for long in (False, True):
        some = [r for r in tested if (r.doc_id % 4 >= 2) == long]
        assert sum(r.predicted == r.doc_id % 2 for r in some) >= 0.95 * len(some) > 40


def test_calibration_settles_on_far_logits():
    net = toxicity.Network(None, None, None, None, 0.0)
    labels = np.array([0, 0, 0, 1] * 75)
    toxicity.calibrate(net, np.where(labels == 1, 9.0, 5.0), labels, ["en"] * 300)
    scores = 1 / (1 + np.exp(-(net.slope * np.array([9.0, 5.0]) + net.shift)))
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_weights_stand_for_rows():
    """A row of weight three does what three rows do."""
    rng = np.random.default_rng(5)
    labels = (rng.random(300) < 0.4).astype(int)
    z = rng.standard_normal(300) + labels
    langs = ["en"] * 200 + ["es"] * 100
    times = np.where(labels == 1, 1, 3)
    shift, thresholds = {}, {}
    for kind in ("repeated", "weighted", "plain"):
        net = toxicity.Network(None, None, None, None, 0.0)
        if kind == "repeated":
            rows = np.repeat(np.arange(300), times)
            toxicity.calibrate(net, z[rows], labels[rows], [langs[i] for i in rows])
        else:
            toxicity.calibrate(net, z, labels, langs, times if kind == "weighted" else None)
        shift[kind], thresholds[kind] = net.shift, net.thresholds
    assert set(thresholds["weighted"]) == {"en", "es"}
    off = abs(shift["weighted"] - shift["repeated"])
    assert off < 0.1 * abs(shift["plain"] - shift["repeated"])


def test_long_texts_score_as_in_one_piece():
    rng = np.random.default_rng(1)
    net = toxicity.train([rng.integers(0, 99, (20, 6)).astype(np.int32) for _ in range(8)], np.array([0, 1] * 4), steps=1)
    slots = rng.integers(0, 1 << toxicity.BITS, (2 * toxicity.BLOCK_WORDS + 77, 6)).astype(np.int32)
    offsets = np.array([0, 3, 3, 4, len(slots) - 5, len(slots)])
    blocks = net.pooled(slots, offsets)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for w, found in enumerate(net.responses(slots[a:b])):
            best = found.max(axis=0).clip(min=0) if len(found) else np.zeros(toxicity.FILTERS)
            np.testing.assert_allclose(blocks[i, w], best, rtol=1e-4, atol=1e-5)


def plain_counts(text):
    w = words(text, fold=False)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set()
    covered = {i + d for i, x in enumerate(windows) if x in many for d in range(3)}
    lines = (text or "").split("\n")
    seen, dups = set(), 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            dups += line in seen
            seen.add(line)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered),
    )


def quality_rows(n):
    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        text = invented("en", i, r.randrange(60, 200))
        bad = i % 3 == 0
        if bad and i % 2:
            text = " ".join(x + "$$" for x in text.split(" "))
        elif bad:
            text = text.upper() + "\n" + text.upper()
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_counts_and_rules(spark):
    rows, labels = quality_rows(600)
    rows += [(9000, "a b c a b c\nx\nx\n \n \nA b c", "en", "s", 1), (9001, "é#ö |<", "en", "s", 1)]
    rows += [(9100 + i,) + r[1:] for i, r in enumerate(awkward())]
    docs = frame(spark, rows, ["n_words", "Rule"])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality_rules.judged(docs, table).collect()}
    assert len(found) == len(rows)
    for r in rows:
        x = found[r[0]]
        if len(words(r[1])) < 3000:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain_counts(r[1])
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.base_failed and x.kept)
    ids = frame(spark, rows).select("doc_id", held_out("doc_id").alias("h")).filter("h").collect()
    tested = [r.doc_id for r in ids if r.doc_id < 600]
    truth = {i: q for i, q, _ in labels}
    right = sum(found[i].kept == bool(truth[i]) for i in tested if not found[i].base_failed)
    assert right >= 0.97 * sum(not found[i].base_failed for i in tested)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(frame(spark, awkward()), none).collect()
    assert {r.rule for r in got} == {0}
    assert quality_rules.judged(frame(spark, []), none).count() == 0


def test_rules_print_and_prune():
    rng = np.random.default_rng(2)
    stats = {"a": rng.random(900), "b": rng.random(900)}
    bad = (stats["a"] > 0.7) & (stats["b"] < 0.5)
    rules = quality_rules.learn_list(stats, bad)
    hit = np.zeros(900, dtype=bool)
    for rule in rules:
        hit |= quality_rules.covers(rule, stats)
    assert (hit == bad).mean() > 0.98
    assert "a >= 0.7" in " and ".join(map(str, rules[0]))[:60] or "b <" in str(rules[0][0])


@pytest.mark.parametrize("most", [3, 50])
def test_per_group_sample_is_bounded(spark, most):
    rows = [(i % 7, "g" if i % 3 else "h") for i in range(500)] + [(i, "rare") for i in range(2)]
    df = keyed(spark.createDataFrame(rows, "v long, g string"), F.col("v"))
    got = {r.g: r["count"] for r in per_group_sample(df, "g", most, 2, 1).groupBy("g").count().collect()}
    assert set(got) <= {"g", "h"} and all(n <= most for n in got.values())
