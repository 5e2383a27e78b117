"""One registered query per operator, over whole tables, with its SQL twin where SQL
can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from skemata.llm import sql
from skemata.llm.bpe import encode_texts
from skemata.llm.chosen_path import near_groups
from skemata.llm.common import read
from skemata.llm.decontam import contaminated
from skemata.llm.language import predict_languages
from skemata.llm.lexical import search
from skemata.llm.licenses import scan
from skemata.llm.line_dedup import dedup_lines
from skemata.llm.prefix_trie import conversation_trie
from skemata.llm.quality_rules import judged
from skemata.llm.registry import QUERIES, SQL, query
from skemata.llm.shards import shuffled_shards
from skemata.llm.token_counts import count_tokens
from skemata.llm.toxicity import toxicity_scores
from skemata.llm.warc import round_trip

__all__ = ["QUERIES", "SQL"]


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return predict_languages(read(spark, sf_dir, "documents"))


@query()
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled into 40 shards."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffled_shards(docs).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, read(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted", "rejected")


@query()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to token ids and back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = tokenizer_path("byte_bpe_50k.json")
    coded = encode_texts(docs, vocab, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(sql.OP5)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key at least ten documents hold are dropped everywhere."""
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices found in the documents."""
    return scan(read(spark, sf_dir, "documents"))


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    rows = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )


@query(sql.OP8)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    records = round_trip(read(spark, sf_dir, "pages"))
    return records.filter("kind <> 'gap'").select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        "refers_to",
    )


@query(sql.OP9)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.8 of a test item's five-word shingles."""
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "item_id", "item_copies", "item_shingles", "found", "containment",
        F.array_join("members", ",").alias("members"),
    )


@query(sql.OP10)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by at least 0.85 of their five-word shingles."""
    groups = near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query(sql.OP11)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return conversation_trie(read(spark, sf_dir, "conversations"))


# Texts of more tokens than this are over the limit.
TOKEN_LIMIT = 512


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


@query(sql.OP13)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for each benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
