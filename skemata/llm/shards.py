"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the records uniformly, by seeded hashes, into buckets that fit
in a task's memory; every shard owns as many buckets as the total size asks for.
Pass two gives each bucket a Fisher-Yates permutation (``shuffle`` of its
positions draws one), places its records by it, and appends the buckets of a
shard one after the other.  Texts cross the network once, and are sorted in
spillable sorts only; what is held in memory is one bucket's positions.

A record's shard follows from its id and the number of shards alone, by the
highest of one seeded hash per shard.  One more shard takes over the records for
which it wins and moves no other.

Defined cases: a null text has no bytes; null ids share a shard, spread over its
buckets by text; repeated rows get slots of their own; an empty table gives an
empty result; columns of the input pass through, and one named like an output
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skemata.llm.common import keyed, without, written

BUCKET_BYTES = 16 << 20
OUTPUTS = ["size", "shard", "slot", "grown_shard"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def winner(key: Column, shards: int, seed: int) -> Column:
    """(hash, shard) of the shard with the highest seeded hash for a key."""
    return F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("shard")),
        )
    )


def shuffled_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with ``size``, ``shard``, ``slot`` (gapless in a shard) and ``grown_shard``."""
    docs = without(docs, [*OUTPUTS, "__k1", "__k2"])
    sized = docs.withColumn("size", text_bytes(F.col(text)) + 16)
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))

    best = winner(F.col(id_col), shards, seed)
    placed = (
        keyed(sized, F.col(id_col), F.col(text))
        .withColumn("__best", best)
        .withColumn("shard", F.col("__best.shard").cast("int"))
        .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__k1"), F.lit(buckets)).cast("int"))
        .withColumn(
            "grown_shard",
            F.when(
                F.xxhash64(F.lit(seed), F.col(id_col), F.lit(shards)) > F.col("__best.h"),
                F.lit(shards),
            ).otherwise(F.col("shard")),
        )
        .drop("__best")
    )

    # bucket sizes, where each bucket begins in its shard, and its permutation
    counted = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    orders = written(
        counted.select(
            "shard",
            "__bucket",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"),
            F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")).alias("__positions"),
        ).withColumn("__positions", F.shuffle("__positions", seed)),
        "bucket-orders",
    )

    in_bucket = Window.partitionBy("shard", "__bucket").orderBy("__k1", "__k2")
    ranked = placed.withColumn("__rank", F.row_number().over(in_bucket))
    return (
        ranked.join(orders, ["shard", "__bucket"])
        .withColumn("slot", F.col("__begin") + F.get("__positions", F.col("__rank") - 1))
        .select(*[c for c in docs.columns], *OUTPUTS)
    )


def write_shards(shuffled: DataFrame, folder: str) -> None:
    """One folder per shard; its files hold runs of slots in order."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
