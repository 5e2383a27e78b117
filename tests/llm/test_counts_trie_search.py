"""Token counts against the library, the conversation trie and the lexical search against
plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, frame, prose
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from skemata.llm import lexical, prefix_trie, pretokens
from skemata.llm.token_counts import count_tokens

FILE = tokenizer_path("byte_bpe_50k.json")


def library():
    found = Tokenizer.from_file(FILE)
    found.no_truncation(), found.no_padding()
    return found


def test_every_code_point_is_cut_as_the_library_cuts_it():
    cut = pretokens.Cutter(pretokens.letter_classes())
    lib = library().pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 4096):
        text = "a1".join(map(chr, points[begin : begin + 4096]))
        assert [text[a:b] for _, (a, b) in lib(text)] == cut(text), hex(points[begin])


@pytest.mark.parametrize("most", [200_000, 30, 0])
def test_token_counts_equal_the_library(spark, most):
    r = random.Random(5)
    stock = list("ab \n\t'sé\u00a0中٣!😀\u0085") + ["<|endoftext|>", "'re", "  ", chr(0x10940), "words", " of"]
    texts = ["".join(r.choice(stock) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += ["a" * 300_000, prose(1, 20_000), prose(2, 500), prose(2, 500)]
    rows = awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = frame(spark, rows, ["N_TOKENS", "row", "n", "piece"]).repartition(5)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_tokens) for x in count_tokens(docs, FILE, most=most).collect())
    lib = library()
    want = [
        (str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
        for i, t, *_ in rows
    ]
    assert got == sorted(want)


def test_token_counts_of_an_empty_table(spark):
    assert count_tokens(frame(spark, []), FILE).collect() == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    """Every item against every document, as the contract words it."""
    bags = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    holders = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            if not bag:
                continue
            tf, m = Counter(bag), 100 - 25 + 25 * len(bag) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1)))
                * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                for t in plain_terms(text) if t in tf
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(60_000)]
    docs = [(i, " ".join(words[r.randrange(59_000) :][: r.randrange(1, 90)])) for i in range(700)]
    docs += [(i, t) for i, t, *_ in awkward()]
    docs += [(2000 + i, "the hot PASSAGE, w1-w2;w3 w899") for i in range(90)]  # ties
    items = [(i, " ".join(words[i * 40 : i * 40 + 25])) for i in range(60)]
    items += [(100, None), (101, ""), (102, "?! .."), (103, "unheard-of zzz"), (None, "w5 w6 w7"), (104, "one two")]
    items += [(105, "hot passage hot"), (105, "w899 w899 Straße"), (106, prose(1, 3000)), (107, "w1")]
    return docs, items


@pytest.mark.parametrize("block, tree", [(1024, 4096), (7, 100)])
def test_lexical_search_equals_scoring_all(spark, monkeypatch, block, tree):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "TREE_DOCS", tree)
    monkeypatch.setattr(lexical, "SEED_DOCS", 50)
    docs, items = search_rows()
    got = lexical.search(
        spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(3),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, item string").coalesce(1),
    ).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_search(docs, items, 20)


def test_lexical_search_of_empty_tables(spark):
    docs, items = search_rows()
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items)):
        found = lexical.search(a, b)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    text_ids = lexical.search(docs.withColumn("doc_id", docs.doc_id.cast("string")), items)
    assert dict(text_ids.dtypes)["doc_id"] == "string" and text_ids.count() > 100


def test_the_tree_prunes_and_loses_nothing():
    r = np.random.default_rng(2)
    n_terms = 3000
    topic = r.permutation(np.repeat(np.arange(10), 300))  # 3,000 documents on ten topics
    rows = [np.unique(t * 300 + r.integers(0, 60, 25)) for t in topic]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    docs = lexical.Vectors(ptr, np.concatenate(rows), r.integers(1, 1000, ptr[-1]))
    items = docs.taken(np.arange(0, 3000, 50))
    k = 5
    found = lexical.Items(items, n_terms, k, np.zeros(60, dtype=np.int64))
    scored, all_pairs = lexical.search_tree(found, lexical.Tree(docs, np.ones(n_terms), lexical.DOC_LEAF), list(range(3000)))
    assert scored < all_pairs / 2
    dense = np.zeros((3000, n_terms), dtype=np.int64)
    dense[np.repeat(np.arange(3000), np.diff(ptr)), docs.terms] = docs.values
    scores = dense[::50] @ dense.T
    for at, item in enumerate(found.tree.order):
        want = sorted((-s, d) for d, s in enumerate(scores[item].tolist()))[:k]
        assert [(a, d) for a, _, d in found.best[at]] == want


CONVERSATIONS = "conv_id long, turn long, role string, text string, path string, depth int"


def plain_trie(rows):
    """Nodes by dictionary, as the contract words them; turns have distinct numbers."""
    own = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, below = {}, {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    parents = {node[:-1] for node in members if node}
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(seqs[c]) == len(node)))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(x[:-1] == node for x in below[node] if len(x) == len(node) + 1),
            sum(x not in parents for x in below[node]),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[node] if x),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_rows():
    r = random.Random(9)
    rows = []
    for c in [*range(0, 330), *range(-5, 0), 700, 701, 799]:
        if c % 37 == 5:
            continue
        for turn in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, turn, r.choice(["user", None, "u"]), r.choice(["hi", "", None, "é😀", "long " * 9])))
    rows += [(900 + c, t, "user", "the same") for c in range(60) for t in range(7)]  # copies
    rows += [(1000, t, "user", f"t{t}") for t in range(400)] + [(1001, t, "user", f"t{t}") for t in range(390)]
    rows += [(1100, None, "x", "first"), (1100, 4, "x", "last"), (None, 1, "a", "nobody"), (1200, 1, None, None)]
    return [(*x, "clash", 1) for x in rows]


@pytest.mark.parametrize("shards, piece", [(1, 1 << 20), (7, 1 << 20), (60, 30), (8, 1)])
def test_trie_equals_dictionaries(spark, monkeypatch, shards, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = trie_rows()
    random.Random(1).shuffle(rows)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(4), shards)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_ties_and_empty_tables(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.conversation_trie(none, 4).collect() == []
    rows = [(7, 1, "a", "b", "", 0)] * 3 + [(7, 1, "c", "d", "", 0), (None, None, None, None, None, None)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS), 4).collect()
    assert all(x.n_convs == 1 for x in got) and {x.conv_id for x in got} == {7}
