"""Expressions over SQL text and answers: references, name-like words, wrappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skemata.functions.text import strip

# Words after FROM, JOIN, ... that are not tables.
NOT_TABLES = [
    "select", "where", "set", "values", "key", "index", "constraint", "primary",
    "foreign", "unique", "check", "default", "null", "true", "false", "on", "as",
    "and", "or", "not", "in", "is", "like", "between", "exists",
]

# Shapes of names, of stand-in statements and of an answer's wrapping.
TABLE_WORDS = ["FROM", "JOIN", "UPDATE", "INTO", "TABLE"]
SNAKE_NAME = r"\b([a-z]+_[a-z][a-z0-9_]*(?:_[a-z][a-z0-9_]*)*)\b"
UPPER_NAME = r"\b([A-Z][A-Z]+(?:_[A-Z][A-Z]+)+)\b"
CAMEL_NAME = r"\b([A-Z][a-z]+[A-Z][a-zA-Z]*)\b"
STAND_IN = r"(?i)\bSELECT\s+(?:0\b|NULL\b|\d+\s+AS\s+)"
FENCED_SQL = r"(?is)```(?:sql)?\s*\n?(.*?)\n?```"
STATEMENT = r"(?is)\b((?:SELECT|INSERT|UPDATE|DELETE|WITH)\b.*?;)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def table_refs(sql: Column, keep_case: bool = False, strict: bool = False) -> Column:
    """Distinct table names after FROM, JOIN, UPDATE, INTO and TABLE.

    Each word is searched for by itself, so that one does not take the next as its
    name.  ``strict`` also drops names that a WITH clause defines.
    """
    text = F.coalesce(sql, F.lit(""))
    names = F.concat(
        *[_all(text, rf"(?i)\b{word}\s+([A-Za-z_][A-Za-z0-9_]*)") for word in TABLE_WORDS]
    )
    stop = F.array(*[F.lit(w) for w in NOT_TABLES])
    names = F.filter(names, lambda n: ~F.array_contains(stop, F.lower(n)))
    if not keep_case:
        names = F.transform(names, F.lower)
    names = F.array_distinct(names)
    if strict:
        defined = F.transform(
            _all(F.coalesce(sql, F.lit("")), r"(?i)(?:\bWITH(?:\s+RECURSIVE)?|,)\s+([A-Za-z_][A-Za-z0-9_]*)\s+AS\s*\("),
            F.lower,
        )
        names = F.filter(names, lambda n: ~F.array_contains(defined, F.lower(n)))
    return names


def identifier_tokens(text: Column) -> Column:
    """Distinct lower-case tokens that look like table or column names."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(
        F.concat(
            _all(text, SNAKE_NAME),
            F.transform(_all(text, UPPER_NAME), F.lower),
            F.transform(_all(text, CAMEL_NAME), F.lower),
        )
    )


def extract_sql(answer: Column) -> Column:
    """Statement inside a model answer; empty text when there is none."""
    text = strip(F.coalesce(answer, F.lit("")))
    fenced = F.when(text.rlike(FENCED_SQL), strip(F.regexp_extract(text, FENCED_SQL, 1)))
    text = F.coalesce(fenced, text)
    text = strip(F.regexp_replace(text, r"^(?:SQL|sql)\s*:\s*", ""))
    return F.coalesce(
        F.nullif(strip(F.regexp_extract(text, STATEMENT, 1)), F.lit("")),
        F.when(text.rlike(r"(?i)^(?:SELECT|WITH)"), text),
        F.lit(""),
    )


def is_stand_in(sql: Column) -> Column:
    return F.coalesce(sql.rlike(STAND_IN), F.lit(False))
