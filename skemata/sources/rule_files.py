"""Rule tables: from YAML files, as DataFrames, and user rules held in a table."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.functions.rules import (
    PATTERNS,
    PII_RULES,
    SEMANTIC_CONFIDENCE,
    SEMANTIC_RULES,
    Pattern,
    Rule,
    is_regex,
)
from skemata.scale import skew_join

NAME_RULES_SCHEMA = "rule_ord int, pattern string, classification string, confidence double"


def _load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def read_rules(folder: str | None = None) -> tuple[list[Rule], list[Rule]]:
    """Sensitive and semantic rules; a missing file means no rules of that kind."""
    if not folder:
        return list(PII_RULES), list(SEMANTIC_RULES)
    pii_file = os.path.join(folder, "pii_rules.yaml")
    semantic_file = os.path.join(folder, "semantic_type_rules.yaml")
    pii = _load(pii_file).get("pii_columns", []) if os.path.isfile(pii_file) else []
    semantic = (
        _load(semantic_file).get("semantic_types", []) if os.path.isfile(semantic_file) else []
    )
    return (
        [Rule(r["pattern"], r["classification"], float(r["confidence"])) for r in pii],
        [Rule(r["pattern"], r["type"], SEMANTIC_CONFIDENCE) for r in semantic],
    )


def read_patterns(folder: str | None = None) -> list[Pattern]:
    if not folder:
        return list(PATTERNS)
    found = _load(os.path.join(folder, "pattern_rules.yaml")).get("patterns", {})
    return [
        Pattern(name, body.get("description", ""), tuple(body.get("indicators", [])))
        for name, body in found.items()
    ]


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.pattern, r.label, float(r.confidence)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, NAME_RULES_SCHEMA)


def classify_by_rule_table(
    columns: DataFrame, rules: DataFrame, regex_rules: Sequence[tuple[int, Rule]] = ()
) -> DataFrame:
    """First match against a rule table of any size.

    A plain pattern matches when it equals a substring of the name, so distinct
    names are cut into substrings and equi-joined with the patterns: no pair of
    name and rule is formed unless it matches.  Regular expressions cannot be
    looked up; pass them as ``(rule_ord, rule)`` and they become one expression.
    """
    names = columns.select("column_name").distinct()
    low = F.lower("column_name")
    lengths = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    starts = F.flatten(
        F.transform(
            lengths,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))),
                lambda i: F.substring(low, i, n),
            ),
        )
    )
    pieces = names.select("column_name", F.explode(F.array_distinct(starts)).alias("piece"))
    plain = rules.select(F.lower("pattern").alias("piece"), "rule_ord", "classification", "confidence")
    hits = pieces.join(plain, "piece").select(
        "column_name", F.struct("rule_ord", "classification", "confidence").alias("hit")
    )
    if regex_rules:
        found = [
            F.when(
                F.col("column_name").rlike("(?iu)" + r.pattern),
                F.struct(
                    F.lit(o).alias("rule_ord"),
                    F.lit(r.label).alias("classification"),
                    F.lit(float(r.confidence)).alias("confidence"),
                ),
            )
            for o, r in sorted(regex_rules, key=lambda pair: pair[0])
        ]
        hits = hits.unionByName(
            names.select("column_name", F.coalesce(*found).alias("hit")).filter("hit is not null")
        )
    first = hits.groupBy("column_name").agg(F.min("hit").alias("hit"))
    # a name such as "id" may be carried by a large share of all columns
    named = skew_join(
        columns, first, ["column_name"], "left", ["database_id", "table_name", "column_ordinal"]
    )
    return named.select(
        *columns.columns,
        F.col("hit.classification").alias("classification"),
        F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"),
    )


def split_rules(rules: Sequence[Rule]) -> tuple[list[tuple[int, Rule]], list[tuple[int, Rule]]]:
    """(plain, regex) rules with their order kept."""
    numbered = list(enumerate(rules))
    return (
        [(i, r) for i, r in numbered if not is_regex(r.pattern)],
        [(i, r) for i, r in numbered if is_regex(r.pattern)],
    )
