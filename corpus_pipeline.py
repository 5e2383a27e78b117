"""The corpus pipeline: documents to token ids in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept.  Stages return the columns of ``documents``, the last one token ids.
"""

from __future__ import annotations

import functools

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.llm.bpe import encode_texts
from skemata.llm.chosen_path import keep_one_each
from skemata.llm.common import read, tune
from skemata.llm.decontam import drop_contaminated
from skemata.llm.line_dedup import OUTPUTS, dedup_lines
from skemata.llm.toxicity import drop_toxic
from skemata.session import configure, work_folder


def ready(spark: SparkSession) -> SparkSession:
    """Settings, code and a shared folder, for stages that are called one by one, too."""
    return tune(configure(spark))


# The columns that stages work with; all others pass through under other names.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def whole_rows(stage):
    """A stage for documents with any other columns, whatever their names: they are
    numbered while the stage works, and come back as they were.  Nulls in them stay."""

    @functools.wraps(stage)
    def shielded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = docs.toDF(*[c if c in USED else f"passed{i}" for i, c in enumerate(names)])
        return stage(spark, plain, sf_dir).toDF(*names)

    return shielded


@whole_rows
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents, by the threshold of their language (0.3 where it is null or
    too few of its documents are labelled); null and empty texts are scored like others,
    equal rows alike."""
    ready(spark)
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


@whole_rows
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more hold; ``n_chars``, where there is one, follows
    the text.  No row goes: a text that loses all its lines is empty, a null text stays
    null, and equal rows count as documents of their own."""
    ready(spark)
    columns = docs.columns
    kept = dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    kept = kept.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in columns:
        length = F.length("text").cast("long")
        kept = kept.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return kept.drop(*OUTPUTS).select(*columns)


@whole_rows
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a similarity of 0.8 or more, that with the
    smallest id; texts without words are no copies of each other, of rows equal in id and
    text one stays."""
    ready(spark)
    return keep_one_each(docs, percent=80)


@whole_rows
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain 0.8 or more of a test item's shingles; texts without
    words contain none."""
    ready(spark)
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text again; a null text has no ids and
    is exact.  Returns ids, not the columns of documents."""
    ready(spark)
    vocab = tokenizer_path("byte_bpe_50k.json")
    slim = docs.select("doc_id", "lang", "source", "text")
    coded = encode_texts(slim, vocab, decoded="decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

# SQL has no trained classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
