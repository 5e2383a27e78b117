"""Ordered first-match rules as one expression, with no join per rule."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    pattern: str
    label: str
    confidence: float


class Pattern(NamedTuple):
    name: str
    description: str
    indicators: tuple[str, ...]


# Characters that make a pattern a regular expression.
REGEX_CHARS = "|.*+?^$()[]{}"

# Confidence of a semantic rule.
SEMANTIC_CONFIDENCE = 0.85

# Sensitive-column rules, in order.
PII_RULES = [
    Rule("email", "EMAIL", 0.95),
    Rule("phone", "PHONE", 0.95),
    Rule("mobile", "PHONE", 0.90),
    Rule("aadhaar", "GOVT_ID", 0.98),
    Rule("pan", "GOVT_ID", 0.98),
    Rule("passport", "GOVT_ID", 0.98),
]

# Semantic-type rules, in order.
SEMANTIC_RULES = [
    Rule("email", "EMAIL", SEMANTIC_CONFIDENCE),
    Rule("phone|mobile|telephone", "PHONE", SEMANTIC_CONFIDENCE),
    Rule("first_name|fname|firstname", "FIRST_NAME", SEMANTIC_CONFIDENCE),
    Rule("last_name|lname|lastname", "LAST_NAME", SEMANTIC_CONFIDENCE),
    Rule("dob|date_of_birth", "DATE_OF_BIRTH", SEMANTIC_CONFIDENCE),
    Rule("country", "COUNTRY", SEMANTIC_CONFIDENCE),
    Rule("city", "CITY", SEMANTIC_CONFIDENCE),
    Rule("state|province", "STATE", SEMANTIC_CONFIDENCE),
    Rule("status", "STATUS", SEMANTIC_CONFIDENCE),
    Rule("created_at|updated_at", "TIMESTAMP", SEMANTIC_CONFIDENCE),
]

# Schema patterns and the columns that indicate them.
PATTERNS = [
    Pattern(
        "audit_trail",
        "Columns tracking creation and modification timestamps and users",
        ("created_at", "updated_at", "created_by", "updated_by"),
    ),
    Pattern(
        "soft_delete",
        "Rows are marked as deleted rather than removed",
        ("deleted_at", "is_deleted", "deleted_flag"),
    ),
    Pattern(
        "multi_tenancy",
        "Data is isolated by tenant identifier",
        ("tenant_id", "organization_id", "company_id"),
    ),
    Pattern("versioning", "Rows track version history", ("version", "version_number", "revision")),
    Pattern(
        "state_machine",
        "Rows transition through defined states",
        ("status", "state", "lifecycle_stage"),
    ),
]


def is_regex(pattern: str) -> bool:
    return any(ch in REGEX_CHARS for ch in pattern)


def matches(pattern: str, name: Column) -> Column:
    """Case-insensitive search; plain patterns are substring tests."""
    if is_regex(pattern):
        return name.rlike("(?iu)" + pattern)
    return F.contains(F.lower(name), F.lit(pattern.lower()))


def _label(label: Column, confidence: Column) -> Column:
    return F.struct(
        label.cast("string").alias("classification"), confidence.cast("double").alias("confidence")
    )


def first_match(name: Column, rules: Sequence[Rule]) -> Column:
    """Struct (classification, confidence) of the first rule that matches."""
    hits = [
        F.when(matches(r.pattern, name), _label(F.lit(r.label), F.lit(r.confidence)))
        for r in rules
    ]
    return F.coalesce(*hits, _label(F.lit(None), F.lit(0.0)))


def classify(
    name: Column,
    pii: Sequence[Rule] = PII_RULES,
    semantic: Sequence[Rule] = SEMANTIC_RULES,
) -> Column:
    return first_match(name, [*pii, *semantic])


def classify_semantic(name: Column, semantic: Sequence[Rule] = SEMANTIC_RULES) -> Column:
    return first_match(name, semantic)
