"""Small tables with awkward rows, and plain Python versions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, fold=True):
    found = WORD.findall(text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found] if fold else found


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    if len(w) < width:
        return {tuple(w)}
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def prose(seed, n, stock=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}x{r.randrange(stock)}" for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.random()}" if r.random() < share else w for w in text.split(" "))


def awkward():
    """Nulls, empty and blank texts, a very long text, repeated rows, ties."""
    long = prose(1, 30000)
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b ", None, None, 5),
        (4, "one two", "en", "b", 7),
        (5, "one two", "en", "b", 7),
        (5, "one two", "en", "b", 7),
        (6, long, "fr", "c", len(long)),
        (7, long + " tail", "fr", "c", len(long) + 5),
        (None, "no id here but words enough for shingles", "de", "d", 40),
        (None, None, None, None, None),
        (8, "Straße ÄÖİ   nbsp \U0001f600 emoji\x85line", "de", "d", 30),
    ]


def frame(spark, rows, extra=()):
    """A documents table; ``extra`` names columns that clash with outputs."""
    schema = DOCS + "".join(f", `{n}` string" for n in extra)
    return spark.createDataFrame([tuple(r) + ("x",) * len(extra) for r in rows], schema)
