"""Snapshots kept with digests, so that a delta reads only what differs.

A snapshot is items in folders by a hash of their key (a section of a category of a
connection, say), and two small tables: a digest per key, folded from hashes of the items
and their places, and a digest per folder, folded from those of its keys.  Two snapshots
are compared from the top: folders with equal digests are not opened, keys with equal
digests not compared, and only items of the others are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.operators.snapshots import item_delta
from skemata.scale import skew_join

# Folders of a snapshot; their digests are what the driver compares.
FOLDERS = 256


def _folder(keys: Sequence[str], folders: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")


def _folded(*parts: str | Column) -> list[Column]:
    """Order-free digest of the rows of a group, in two columns."""
    return [
        F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit(5), *parts)).alias("mixed"),
    ]


def write_snapshot(
    items: DataFrame, path: str, keys: Sequence[str], ordinal: str = "ordinal", folders: int = FOLDERS
) -> None:
    """``items`` (keys, item_hash, ordinal, and others) with their digests."""
    placed = items.withColumn("folder", _folder(keys, folders))
    # a hot key is written by several tasks
    spread = F.pmod(F.xxhash64("item_hash", ordinal), F.lit(8))
    placed.repartition("folder", spread).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/items")
    of_keys = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ordinal).alias("ordinals"), *_folded("item_hash", ordinal)
    )
    of_keys.withColumn("folder", _folder(keys, folders)).write.mode("overwrite").parquet(f"{path}/keys")
    made = items.sparkSession.read.parquet(f"{path}/keys")
    of_folders = made.groupBy("folder").agg(*_folded(*keys, "n", "total", "mixed"))
    of_folders.coalesce(1).write.mode("overwrite").parquet(f"{path}/folders")


def differing_folders(spark: SparkSession, old: str, new: str) -> list[int]:
    """Folders whose digests differ; at most as many as there are folders."""
    a, b = (spark.read.parquet(f"{p}/folders") for p in (old, new))
    both = a.join(b.withColumnsRenamed({"total": "total2", "mixed": "mixed2"}), "folder", "full")
    same = F.col("total").eqNullSafe(F.col("total2")) & F.col("mixed").eqNullSafe(F.col("mixed2"))
    return sorted(r.folder for r in both.filter(~same).select("folder").collect())


def differing_keys(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """The keys of both snapshots, with ``differs``, and ``n`` and ``ordinals`` of the new one."""
    a, b = (spark.read.parquet(f"{p}/keys") for p in (old, new))
    a = a.select(*keys, F.col("total").alias("__t"), F.col("mixed").alias("__m"), F.col("n").alias("__n"))
    same = (
        F.col("__t").eqNullSafe(F.col("total")) & F.col("__m").eqNullSafe(F.col("mixed")) & F.col("__n").eqNullSafe(F.col("n"))
    )
    return a.join(b, list(keys), "full").select(*keys, "n", "ordinals", (~same).alias("differs"))


def items_of(spark: SparkSession, path: str, folders: Sequence[int]) -> DataFrame:
    """Items of some folders; the others are not opened."""
    return spark.read.parquet(f"{path}/items").filter(F.col("folder").isin(list(folders)))


def stored_delta(spark: SparkSession, old: str, new: str, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """``item_delta`` for the keys that differ; items of all other keys are unchanged."""
    folders = differing_folders(spark, old, new)
    changed = differing_keys(spark, old, new, keys).filter("differs").select(*keys)
    sides = [
        skew_join(items_of(spark, p, folders), changed, list(keys), "left_semi", ["item_hash"]) for p in (old, new)
    ]
    return item_delta(*sides, keys, ordinal)


def delta_counts(spark: SparkSession, old: str, new: str, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Items by key and change, and the sum of their ordinals; those of keys that do not
    differ come from the digests."""
    read = stored_delta(spark, old, new, keys, ordinal).groupBy(*keys, "change").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ordinal).alias("ordinals")
    )
    rest = differing_keys(spark, old, new, keys).filter("not differs")
    return read.unionByName(rest.select(*keys, F.lit("unchanged").alias("change"), "n", "ordinals"))


def changed_sections(spark: SparkSession, old: str, new: str, keys: Sequence[str], section: str = "section") -> DataFrame:
    """Sections whose list differs in any place, per key, from the digests alone."""
    differ = differing_keys(spark, old, new, [*keys, section])
    return differ.groupBy(*keys).agg(F.count_if("differs").alias("changed_sections"))
