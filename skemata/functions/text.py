"""Small text helpers with the whitespace and case rules of the catalog format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space below U+3001; the usual set trimmed by text tools.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def filled(c: Column) -> Column:
    """True when the text has something other than white space."""
    return F.coalesce(strip(c) != "", F.lit(False))


def blank_to(c: Column, other: Column) -> Column:
    """``c`` unless null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def title(c: Column) -> Column:
    """Capital after every non-letter, unlike initcap which only splits at spaces."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def compact(name: Column) -> Column:
    """Lower case without separators, for matching spellings of one name."""
    return F.translate(F.lower(name), "_- ", "")
