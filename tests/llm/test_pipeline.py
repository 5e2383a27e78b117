"""The stages of the pipeline on awkward rows and clashing columns."""

import corpus_pipeline
import pytest
from helpers import awkward, frame, prose
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ["n_lines", "n_dropped", "kept_text", "__k1", "__k2", "__maybe", "score", "id", "Size", "name", "members"]


def rows():
    line = "a line that very many documents share here"
    out = awkward() + [(100 + i, f"{line}\n{prose(i, 40)}", "en", "s", 1) for i in range(12)]
    copy = prose(77, 60)
    return out + [(200, copy, "en", "s", 1), (201, copy + " more", "en", "s", 1), (202, line, "xx", "s", 1)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_other_columns_pass_through(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, rows(), CLASHES)
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat_ws("-", F.lit(f"v{i}"), F.col("doc_id").cast("string")))
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    found = got.collect()
    for r in found:
        for i, c in enumerate(CLASHES):
            assert r[c] == (f"v{i}-{r.doc_id}" if r.doc_id is not None else f"v{i}")
    ids = [r.doc_id for r in found]
    if name == "line_dedup":
        assert len(found) == len(rows())
        by = {r.doc_id: r for r in found}
        assert by[100].text == prose(0, 40) and by[100].n_chars == len(prose(0, 40)) and by[202].text == ""
        assert by[1].text is None
    if name == "near_dedup":
        assert 200 in ids and 201 not in ids and ids.count(5) == 0 and 4 in ids
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_tokens_decode_to_the_texts(spark):
    got = corpus_pipeline.tokenize(spark, frame(spark, rows()), SF).collect()
    assert len(got) == len(rows()) and all(r.exact for r in got)
    assert all(r.n_tokens == 0 for r in got if r.doc_id == 1)


def test_line_dedup_without_a_length(spark):
    got = corpus_pipeline.line_dedup(spark, frame(spark, rows()).drop("n_chars"), SF)
    assert got.columns == ["doc_id", "text", "lang", "source"] and got.count() == len(rows())
