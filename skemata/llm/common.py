"""What the operators share: row keys, column hygiene, Arrow settings, written tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skemata.session import broadcast_by_guess, name_folder, work_folder

# Rows handed to Python at once; texts are cut further by their bytes there.
ARROW_ROWS = 1000
ROWS_PER_FILE = 50_000


def tune(spark: SparkSession) -> SparkSession:
    name_folder(spark)
    broadcast_by_guess(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *parts: Column) -> DataFrame:
    """Adds ``__k1, __k2``: 128 bits that tell rows apart by ``parts`` (null-safe).

    Rows equal in all parts share a key; they are copies and get equal results.
    """
    flags = F.concat(*[p.isNull().cast("string") for p in parts])
    return docs.withColumns(
        {"__k1": F.xxhash64(flags, *parts), "__k2": F.xxhash64(F.lit(7), *parts[::-1], flags)}
    )


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drops columns whose names, in any case, an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends, and its size is known.

    ``rows``, where the caller knows how many there are at most, keeps a small table
    from becoming hundreds of tiny files."""
    folder = work_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, rows // ROWS_PER_FILE))
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """2^bits flags of which leading bits occur in the one long column of ``keys``.

    It reaches the driver in words of 64 flags, so as at most 2^bits / 64 short rows
    however many keys there are; a full bitmap lets everything through."""
    slot = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)
    words = (
        keys.select(slot.alias("slot"))
        .groupBy((F.col("slot") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("flags"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["flags"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) keys may be among those of the bitmap."""
    slot = keys >> np.uint64(64 - (len(bitmap).bit_length() + 5))
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string")) % 4).cast("int")


def held_out(id_col: str) -> Column:
    """Rows that no model learns from; a row without id is not one of them."""
    return F.coalesce(remainder(id_col) == 2, F.lit(False))


def per_group_sample(
    rows: DataFrame, group: str, most: int, max_groups: int, seed: int
) -> DataFrame:
    """At most ``most`` rows of each of the ``max_groups`` largest groups.

    A seeded hash of the row key first thins a group to about twice the bound, so
    that only few rows are ranked; the rank makes the bound strict.
    """
    counts = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(max_groups).collect()
    if not counts:
        return rows.limit(0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "__k1"), F.lit(1 << 30))
    shares = F.create_map(
        *chain.from_iterable(
            (F.lit(r[group]), F.lit(min(1.0, 2 * most / r["count"]))) for r in counts
        )
    )
    thinned = rows.withColumn("__draw", draw).filter(
        F.col("__draw") < shares[F.col(group)] * (1 << 30)
    )
    first = Window.partitionBy(group).orderBy("__draw", "__k1", "__k2")
    return (
        thinned.withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") <= most)
        .drop("__draw", "__rank")
    )
