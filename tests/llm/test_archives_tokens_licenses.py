"""WARC salvage, BPE against the tokenizers library, license alignment."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from helpers import awkward, frame, prose
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skemata.llm import bpe, licenses, warc

PAGES = "page_id long, url string, html string, kind string"


def page_rows():
    big, small = "<p>" + prose(3, 60), "<p>tiny"
    rows = [(i, f"http://x/{i}", f"<html>{prose(i, 30 + i)}", "x") for i in range(20, 40)]
    rows += [(7, "http://a", big, "x"), (5, None, big, "x"), (9, "u\r\nv", big, "x"), (5, "dup", big, "x")]
    rows += [(11, "s", small, "x"), (10, "s", small, "x"), (12, None, None, "x"), (13, "", "", "x")]
    rows += [(None, "n", big, "x"), (14, "w", "WARC/1.1\r\n\r\nContent \x1f\x8b\x08 é\r\n\r\n" * 9, "x")]
    rows.append((15, "long", prose(5, 40000), "x"))
    return rows


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    rows = page_rows()
    got = warc.round_trip(
        spark.createDataFrame(rows, PAGES).repartition(3), compress=compress, records_per_file=6
    ).collect()
    assert all(r.kind != "gap" for r in got) and len(got) == len(rows)
    low = {}
    for i, _, html, _ in rows:
        if i is not None and html and len(html.encode()) >= 100:
            low[html] = min(i, low.get(html, i))
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = low.get(html)
        refers = first if first is not None and first != i else None
        want.append(
            (str(i), len(data), hashlib.sha256(data).hexdigest(),
             "response" if refers is None else "revisit", str(refers))
        )
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest, r.kind, str(r.refers_to)) for r in got) == sorted(want)
    for r in got:
        if r.kind == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive(compress, n=12):
    records = []
    for i in range(n):
        body = prose(i, 40).encode()
        r = warc.record_bytes(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)
        if compress:
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            r = z.compress(r) + z.flush()
        records.append(r)
    return records


def check_salvage(content, lost):
    """All but the lost records come back; records and gaps tile the archive."""
    at, ids = 0, []
    for offset, length, record, reason in warc.salvage(content):
        assert offset >= at and not content[at:offset].strip(b"\0")
        at = offset + length
        if record is None:
            assert reason
        else:
            ids.append(int(record.headers["warc-record-id"].split(":")[-1][:-1]))
    assert not content[at:].strip(b"\0")
    assert set(range(12)) - set(ids) <= lost and len(ids) == len(set(ids))
    return ids


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_what_is_intact(compress):
    records = archive(compress)
    starts = [sum(map(len, records[:i])) for i in range(12)]
    whole = b"".join(records)
    assert check_salvage(whole, set()) == list(range(12))
    assert check_salvage(b"junk" + whole + b"junk", set()) == list(range(12))
    r = random.Random(1)
    for trial in range(60):
        k = r.randrange(12)
        at = starts[k] + r.randrange(len(records[k]))
        kind = trial % 4
        if kind == 0:  # a flipped byte
            bad = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
        elif kind == 1:  # bytes lost
            bad = whole[:at] + whole[min(at + 30, starts[k] + len(records[k])) :]
        elif kind == 2:  # bytes put in
            bad = whole[:at] + b"\x1f\x8b\x08WARC/1.1 rubbish" + whole[at:]
        else:  # cut off
            bad = whole[:at]
        check_salvage(bad, {k} if kind < 3 else set(range(k, 12)))


def test_a_wrong_length_hides_nothing():
    records = archive(False)
    mark = records[3].index(b"Content-Length:", records[3].index(b"Block-Digest"))
    for value in (b"1", b"999", b"99999999", b"x"):
        end = records[3].index(b"\r\n", mark)
        bad = records[3][:mark] + b"Content-Length: " + value + records[3][end:]
        ids = check_salvage(b"".join([*records[:3], bad, *records[4:]]), {3})
        assert ids == [0, 1, 2, *range(4, 12)]


def test_damaged_files_are_read_by_spark(spark, tmp_path):
    records = archive(True)
    bad = b"".join([*records[:5], records[5][:50], b"\0\0", *records[6:]])
    (tmp_path / "a.warc.gz").write_bytes(bad)
    got = warc.read_archives(spark, str(tmp_path))
    assert {r.id for r in got.filter("kind = 'response'").collect()} == set(range(12)) - {5}
    gap = got.filter("kind = 'gap'").collect()
    assert len(gap) == 1 and gap[0].offset == sum(map(len, records[:5])) and "cut" in gap[0].reason or gap[0].reason


def odd_texts():
    r = random.Random(1)
    alphabet = [chr(c) for c in range(0x300)] + list("  \n\t\r\x85 　\x1c\x1f") * 20
    alphabet += [chr(r.randrange(0x300, 0x2FFF)) for _ in range(300)] + [chr(r.randrange(0x10000, 0x1FFFF)) for _ in range(99)]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(600)]
    texts += ["a" * 5000, " " * 3000, "<|endoftext|>" * 3 + " x<|endoftext|>", "don't we'll I'VE"]
    texts += [" \n \n  a", "a  ", "  a", "\n  b", "a \n", "aaa" * 100 + "b", "ab" * 777, "x" * 200_000]
    return texts


def test_bpe_equals_the_library(spark):
    file = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    library.no_truncation(), library.no_padding()
    rows = awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(odd_texts())]
    docs = frame(spark, rows, ["IDS", "decoded"])
    got = bpe.decode_texts(bpe.encode_texts(docs, file), file).collect()
    assert len(got) == len(rows)
    for x in got:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == ids
        assert x.decoded == library.decode(ids, skip_special_tokens=False)
    none = bpe.decode_texts(bpe.encode_texts(frame(spark, []), file), file)
    assert none.count() == 0


def test_compatible_means_encoded_as_two():
    vocab = bpe.vocabulary(tokenizer_path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(3)
    plain = [t for t in vocab.halves if vocab.bytes_of[t].isalpha()]
    fits = 0
    for _ in range(3000):
        a, b = r.choice(plain), r.choice(plain)
        joined = (vocab.bytes_of[a] + vocab.bytes_of[b]).decode()
        want = library.encode(joined, add_special_tokens=False).ids == [a, b]
        assert vocab.compatible(a, b) == want
        fits += want
    assert 0 < fits < 3000


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_ordered_and_bounded_by_lcs():
    r = random.Random(6)
    for trial in range(200):
        template = [r.randrange(30) for _ in range(r.randrange(1, 40))]
        text = [w for w in template if r.random() > 0.15]
        for _ in range(r.randrange(6)):
            text.insert(r.randrange(len(text) + 1), r.randrange(60))
        pairs = licenses.align(text, template)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs[:-1], pairs[1:], strict=True))
        assert all(text[a] == template[b] for a, b in pairs)
        assert len(pairs) <= lcs(text, template)
    distinct = list(range(50))
    text = [x for x in distinct if x % 7] + [99]
    assert len(licenses.align(text, distinct)) == lcs(text, distinct)


def test_longest_increasing():
    r = random.Random(8)
    for _ in range(100):
        values = r.sample(range(100), 12)
        picked = [values[i] for i in licenses.increasing(values)]
        assert picked == sorted(picked)
        best = max(
            len(s) for m in range(1 << 12)
            for s in [[v for k, v in enumerate(values) if m >> k & 1]] if s == sorted(s)
        ) if _ < 3 else len(picked)
        assert len(picked) == best


def test_scan(spark):
    rows = awkward()
    rows += [(100, prose(1, 50) + "\nReleased under the MIT License.", "en", "s", 1)]
    rows += [(101, "RELEASED under, the MIT license! Released under the MIT License.", "en", "s", 1)]
    rows += [(102, "released to the MIT crowd under no license", "en", "s", 1)]
    mit = licenses.TEMPLATES["MIT"]
    r = random.Random(2)
    kept = " ".join(w for w in mit.split() if r.random() > 0.08)
    rows += [(103, prose(2, 500) + " " + kept + " " + prose(3, 500), "en", "s", 1)]
    rows += [(104, mit + " " + prose(4, 30) + " " + mit, "en", "s", 1), (105, mit[: len(mit) // 2], "en", "s", 1)]
    got = licenses.scan(frame(spark, rows, ["coverage", "matched"])).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
        text = next(t for i, t, *_ in rows if i == x.doc_id).encode()
        assert text[x.first_byte : x.end_byte].decode() == x.matched
        assert x.coverage >= 0.8
    assert set(by) == {100, 101, 103, 104}
    assert [x.license_id for x in by[100]] == ["MIT-notice"] and len(by[101]) == 2
    assert {x.license_id for x in by[103]} == {"MIT"} and len(by[104]) == 2
    words = licenses.scan_words(pa.array([kept, mit]))
    hashes, bounds = words[0].tolist(), words[1]
    whole = lcs(hashes[: bounds[1]], hashes[bounds[1] :])
    assert by[103][0].n_aligned >= 0.97 * whole
    assert licenses.scan(frame(spark, [])).count() == 0
    assert licenses.scan(frame(spark, rows), templates={"none": "?!"}).count() == 0


def test_words_between_do_not_hide_a_match(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    spread = " ".join(f"{w} zzz yyy" for w in mit)
    texts = {
        1: "Released under the terms of the standard MIT License",
        2: prose(1, 80) + " released under the well known and very short MIT license " + prose(2, 80),
        3: spread,
        4: " ".join(mit[:80] + ["xxx"] * 200 + mit[80:]),
        5: "Released under the " + "xxx " * 30 + "MIT License",
        6: "released to the MIT crowd under no license",
        7: (spread + " ") * 3,
    }
    rows = [(i, t, "en", "s", 1) for i, t in texts.items()]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.license_id) for x in got) == [
        (1, "MIT-notice"), (2, "MIT-notice"), (3, "MIT"), (4, "MIT"), *[(7, "MIT")] * 3,
    ]
    # unique words are the anchors, so a spread text may align a little less than whole
    assert all(x.coverage >= 0.95 for x in got)


def test_variants_are_told_apart(spark):
    names = sorted(n for n in licenses.TEMPLATES if n != "BSD-3-Clause")
    rows = [(i, licenses.TEMPLATES[n], "en", "s", 1) for i, n in enumerate(names)]
    got = licenses.scan(frame(spark, rows)).collect()
    bare = lambda n: n.removesuffix("-notice").removesuffix("-header")
    for i, n in enumerate(names):
        # a header may also be found by its licence's notice
        assert {bare(x.license_id) for x in got if x.doc_id == i} == {bare(n)}, n
