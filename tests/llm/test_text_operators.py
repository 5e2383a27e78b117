"""Line dedup, decontamination, near-dedup, shards: against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from helpers import awkward, edited, frame, prose, shingles
from pyspark.sql import functions as F

from skemata.llm import chosen_path, decontam, line_dedup, shards, wordhash
from skemata.llm.components import components

BLANKS = " \t\n\r\x0b\x0c"


def plain_lines(rows, min_docs, min_chars=1):
    keys = Counter()

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    for r in rows:
        keys.update({key(x) for x in (r[1] or "").split("\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or keys[key(x)] < min_docs]
        out.append((str(r[0]), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def lined_rows():
    r = random.Random(4)
    rows = awkward()
    for i in range(100, 160):
        lines = [prose(i * 7 + k, 4) for k in range(4)] + ["  Common LINE é "] * (i % 3)
        if i % 5 == 0:
            lines.append("rare line")
        if i % 4 == 0:
            lines += ["", "ab"]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", "s", 1))
    return rows


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 3), (13, 1)])
def test_line_dedup(spark, min_docs, min_chars):
    rows = lined_rows()
    got = line_dedup.dedup_lines(
        frame(spark, rows, ["N_Lines", "__k1", "pos"]), min_docs=min_docs, min_chars=min_chars
    )
    assert [c for c in got.columns if c.lower() == "n_lines"] == ["n_lines"]
    assert "pos" in got.columns
    found = sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.kept_text) for x in got.collect())
    assert found == plain_lines(rows, min_docs, min_chars)


def test_line_dedup_hot_line_over_many_tasks(spark):
    """One line in every document, so that its rows cross task borders."""
    rows = [(i, f"own {i}\nhot", "en", "s", 1) for i in range(3000)]
    got = line_dedup.dedup_lines(frame(spark, rows).repartition(16))
    assert got.agg(F.sum("n_dropped")).first()[0] == 3000
    assert got.filter("kept_text like '%hot%'").count() == 0


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_bitmap_round_trip():
    import numpy as np

    keep = line_dedup.unpack(line_dedup.pack(np.array([0, 9, 3])), 12)
    assert np.flatnonzero(~keep).tolist() == [0, 3, 9]


ITEMS = [
    (0, prose(900, 40)), (1, prose(901, 13)), (2, "three short words"), (3, None), (4, ""),
    (5, prose(901, 13)), (6, prose(902, 200)),
]


def contaminated_rows():
    rows = awkward()
    for i in range(200, 260):
        body = prose(i, 60 + 13 * (i % 20)).split(" ")
        if i % 6 < 4:
            item = ITEMS[(0, 1, 6, 0)[i % 6]][1]
            item = edited(item, (0, 0.01, 0.03, 0.06)[(i // 6) % 4], i)
            body[30:30] = item.split(" ")
        rows.append((i, " ".join(body), "en", "s", 1))
    rows.append((300, "THREE short\nwords", "en", "s", 1))
    return rows


def test_decontamination(spark):
    rows = contaminated_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contaminated(frame(spark, rows, ["hits", "shingle"]), items).collect()
    want = set()
    for r in rows:
        mine = shingles(r[1])
        for item in (0, 1, 2, 6):
            theirs = shingles(ITEMS[item][1])
            found = len(mine & theirs)
            if found * 5 >= len(theirs) * 4:
                want.add((r[0], item, len(theirs), found))
    assert {(x.doc_id, x.item_id, x.item_shingles, x.found) for x in got} == want
    assert len(got) == len(want) and len({x[0] for x in want}) > 10
    assert {x.item_copies for x in got if x.item_id == 1} == {2}
    left = decontam.drop_contaminated(frame(spark, rows, ["__k1"]), items)
    bad = {x[0] for x in want}
    assert sorted(str(x.doc_id) for x in left.select("doc_id").collect()) == sorted(
        str(r[0]) for r in rows if r[0] not in bad
    )


def test_decontamination_with_a_full_bitmap(spark):
    """A bitmap of few bits lets nearly everything through; the joins put it right."""
    rows = contaminated_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    a, b = (
        {(x.doc_id, x.item_id) for x in decontam.contaminated(frame(spark, rows), items, bitmap_bits=n).collect()}
        for n in (8, 24)
    )
    assert a == b


def test_decontamination_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminated(frame(spark, []), items).count() == 0
    assert decontam.contaminated(frame(spark, awkward()), items.limit(0)).count() == 0


def plain_groups(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(
        (str(r[0]), len(sets[i]), str(low.get(root(i)) if sets[i] else r[0])) for i, r in enumerate(rows)
    )


def near_rows(copies, group):
    rows = awkward()
    for i in range(20):
        rows.append((400 + i, prose(i, 90), "en", "s", 1))
    base = prose(77, 150)
    # a large group around the threshold, chains included, and exact copies
    for i in range(group):
        rows.append((1000 + i, edited(base, 0.002 * (i % 12), i), "en", "s", 1))
    for i in range(copies):
        rows.append((5000 - i, base.upper(), "en", "s", 1))
    return rows


@pytest.mark.parametrize("percent,leaf,block", [(85, 2048, 1024), (80, 16, 16)])
def test_near_groups(spark, percent, leaf, block):
    rows = near_rows(30, 150)
    docs = frame(spark, rows, ["component_id", "size", "name"])
    got = chosen_path.near_groups(docs, percent=percent, leaf=leaf, leaf_block=block, block=block, depth=4).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == plain_groups(rows, percent)
    for x in got:
        assert x.kept == (x.doc_id == x.component_id or x.n_shingles == 0)


def test_keep_one_each(spark):
    rows = near_rows(30, 20)
    docs = frame(spark, rows, ["kept"])
    left = chosen_path.keep_one_each(docs)
    assert left.columns == docs.columns
    ids = Counter(x.doc_id for x in left.collect())
    want = {g for i, n, g in plain_groups(rows, 85) if n} | {str(r[0]) for r in rows if not shingles(r[1])}
    assert {str(i) for i in ids} == want
    assert ids[4] == 1 and ids[5] == 0


def test_near_groups_empty(spark):
    assert chosen_path.near_groups(frame(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)]
    edges += [(7, 7), (None, 3), (3, 2), (200, 201)]
    names = {v: r.randrange(10**6) for e in edges for v in e if v is not None}
    df = spark.createDataFrame([(names.get(a), names.get(b)) for a, b in edges], "x long, y long")
    got = {x.vertex: x.component for x in components(df).collect()}
    for part in (range(41), range(100, 150), (200, 201)):
        assert {got[names[v]] for v in part} == {min(names[v] for v in part)}
    assert components(df.limit(0)).count() == 0


def test_shards(spark):
    rows = awkward() + [(1000 + i, prose(i, i % 60), "en", "s", 1) for i in range(700)]
    docs = frame(spark, rows, ["Slot", "__bucket2"])
    got = shards.shuffled_shards(docs, bucket_bytes=400).collect()
    again = shards.shuffled_shards(docs.repartition(5), bucket_bytes=400).collect()
    assert len(got) == len(rows)
    slots = {}
    for x in got:
        assert x.size == len((x.text or "").encode()) + 16
        assert x.grown_shard in (x.shard, 40)
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 40 and any(x.grown_shard == 40 for x in got)
    assert {(x.doc_id, x.shard) for x in got} == {(x.doc_id, x.shard) for x in again}
    # one more shard gives what was foretold
    grown = shards.shuffled_shards(docs, shards=41).collect()
    assert {(x.doc_id, x.grown_shard) for x in got} == {(x.doc_id, x.shard) for x in grown}
    # shuffled: slots do not follow ids
    shard = sorted((x.slot, x.doc_id) for x in got if x.shard == 3 and x.doc_id)
    assert [d for _, d in shard] != sorted(d for _, d in shard)
    assert shards.shuffled_shards(frame(spark, [])).count() == 0


def test_shards_are_written_in_order(spark, tmp_path):
    rows = [(i, prose(i, 20), "en", "s", 1) for i in range(300)]
    shards.write_shards(shards.shuffled_shards(frame(spark, rows), shards=3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 300


def test_word_hashes_agree_with_python():
    import pyarrow as pa

    texts = [r[1] for r in awkward()] + ["x" * 3_000_000 + " y", "a\x1cb c\x85d"]
    hashes, bounds = wordhash.text_words(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        mine = hashes[bounds[i] : bounds[i + 1]].tolist()
        theirs = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in
                  __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert len(mine) == len(theirs)
        for h, w in zip(mine, theirs, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(seen.values()))


def test_query_digests(spark, sf):
    from skemata.llm.queries import QUERIES

    got = QUERIES["op2_shards"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {x.doc_id: x.text_crc32 for x in got} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}
    kept = QUERIES["op5_line_dedup"](spark, sf).collect()
    plain = {i: (n, g, k) for i, n, g, k in plain_lines([(i, t) for i, t in texts.items()], 10)}
    for x in kept:
        n, gone, text = plain[str(x.doc_id)]
        assert (x.n_lines, x.n_dropped) == (n, gone)
        assert x.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_items_without_an_id_are_found(spark):
    from skemata.llm import decontam

    passage = prose(5, 30)
    docs = frame(spark, [(1, "x " + passage + " y", "en", "s", 1), (2, prose(6, 30), "en", "s", 1)])
    items = spark.createDataFrame([(None, passage), (None, passage), (7, prose(6, 30)), (8, prose(6, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.item_copies, tuple(r.members)) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, None, 2, ()), (2, 7, 2, (7, 8))}
    assert decontam.drop_contaminated(docs, items).count() == 0
