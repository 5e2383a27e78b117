"""Helpers that keep hot keys and long groups from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skemata.session import stored

# Lines strung together in the first of two steps of a long text.
LINES_PER_STEP = 2000


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    salt_by: Sequence[str],
    salts: int = 1,
) -> DataFrame:
    """Equi-join whose left side may hold one key in a third of its rows.

    By default the split is left to the adaptive skew join (``session`` turns it
    on, also where it costs one more exchange): it sees real partition sizes,
    cuts the hot ones and repeats only the right rows that belong to them.

    With ``salts`` > 1 every left key is spread by a hash of ``salt_by`` (columns
    that tell the rows of one key apart) and the right side is repeated per
    salt; for a right side known to be small next to the left one.

    Left joins of any kind keep this right: each left row meets every right row
    of its key exactly once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the left side cannot be split for a {how} join")
    if salts == 1:
        return left.join(right, list(on), how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def part_of(ordinal: str | Column, rows: int = LINES_PER_STEP) -> Column:
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(ordinal / F.lit(rows)).cast("bigint")


def joined_lines(order: Sequence[str | Column], line: Column, sep: str) -> Column:
    """Aggregate: the lines of a group in order, joined to one text."""
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    fields = [c.alias(f"o{i}") for i, c in enumerate(ordered)]
    rows = F.array_sort(F.collect_list(F.struct(*fields, line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), sep)


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    line: Column,
    sep: str = "\n",
    rows: int = LINES_PER_STEP,
) -> DataFrame:
    """One text per ``rows`` lines of a key; small groups give one part 0."""
    return df.groupBy(*keys, part_of(ordinal, rows).alias("part_no")).agg(
        joined_lines([ordinal], line, sep).alias("text")
    )


def whole_text(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    line: Column,
    sep: str = "\n",
    rows: int = LINES_PER_STEP,
) -> DataFrame:
    """One text per key where the result must be whole (it gets hashed).

    Lines are sorted and joined per part, in parallel; the last step only
    strings finished parts together.
    """
    parts = text_parts(df, keys, ordinal, line, sep, rows)
    return parts.groupBy(*keys).agg(joined_lines(["part_no"], F.col("text"), sep).alias("text"))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows per key.  The rank filter becomes a per-task group limit,
    so a hot key sends at most k rows per task through the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based numbers per key, without gathering a key in one task.

    Rows are range-partitioned by key and order, numbered inside their
    partition, and shifted by the rows of the same key in earlier partitions.
    The sorted rows are written because they are read twice and must keep their
    numbers when an executor is lost in between; so are the rows themselves, which
    are read once for the ranges and once to be dealt.
    """
    placed = stored(
        stored(df, "unnumbered")
        .repartitionByRange(*[F.col(c) for c in (*keys, *order)])
        .sortWithinPartitions(*keys, *order)
        .withColumn("__pos", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__pos", 33)),
        "numbered",
    )
    runs = placed.groupBy(*keys, "__part").agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = runs.select(
        *[F.col(c).alias(f"__k_{c}") for c in keys],
        F.col("__part").alias("__k_part"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col("__part") == F.col("__k_part")
    for c in keys:
        same = same & (F.col(c) == F.col(f"__k_{c}"))
    # one row per key and partition; a hot key is already spread over partitions
    return placed.join(shift, same).select(
        *df.columns, (F.col("__pos") + F.col("__shift")).alias(name)
    )
