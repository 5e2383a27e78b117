"""Rule labels, schema patterns, and the data work around model answers.

The model itself is outside: prompts leave as text rows and answers come back
as a table of ``(database_id, pass_no, batch_no, answer)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.jsontext import answer_json
from skemata.functions.rules import (
    PATTERNS,
    PII_RULES,
    SEMANTIC_RULES,
    Pattern,
    Rule,
    classify,
    classify_semantic,
)
from skemata.functions.text import blank_to
from skemata.scale import joined_lines, part_of, whole_text

COLUMN_KEY = ["database_id", "table_name", "column_name"]

# Tables per column batch.
TABLES_PER_BATCH = 10


def classify_columns(
    columns: DataFrame,
    pii: Sequence[Rule] = PII_RULES,
    semantic: Sequence[Rule] = SEMANTIC_RULES,
) -> DataFrame:
    """Adds ``classification`` and ``confidence`` from the first rule that matches."""
    return columns.withColumn(
        "__c", classify(F.col("column_name"), pii, semantic)
    ).select(*columns.columns, "__c.*")


def classify_columns_semantic(
    columns: DataFrame, semantic: Sequence[Rule] = SEMANTIC_RULES
) -> DataFrame:
    return columns.withColumn(
        "__c", classify_semantic(F.col("column_name"), semantic)
    ).select(*columns.columns, "__c.*")


def merge_semantic_types(rule_types: DataFrame, model_types: DataFrame) -> DataFrame:
    """Union of both label sets; the rule label wins where both exist."""
    rules = rule_types.filter(F.col("classification").isNotNull()).select(
        *COLUMN_KEY, F.col("classification").alias("rule_type")
    )
    model = model_types.filter(F.col("semantic_type").isNotNull()).select(
        *COLUMN_KEY, F.col("semantic_type").alias("model_type")
    )
    return rules.join(model, COLUMN_KEY, "full").select(
        *COLUMN_KEY,
        F.coalesce("rule_type", "model_type").alias("semantic_type"),
        F.when(F.col("rule_type").isNotNull(), F.lit("rule"))
        .otherwise(F.lit("model"))
        .alias("source"),
    )


def pattern_hits(columns: DataFrame, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Indicator columns, one row per column and pattern.

    Indicators are a literal map in the expression, so this is a projection: no
    join, and usable on a stream.
    """
    by_name: dict[str, list[int]] = {}
    for number, pattern in enumerate(patterns):
        for indicator in sorted({i.lower() for i in pattern.indicators}):
            by_name.setdefault(indicator, []).append(number)
    entries = []
    for name, numbers in by_name.items():
        found = [
            F.struct(
                F.lit(n).alias("pattern_ord"),
                F.lit(patterns[n].name).alias("pattern"),
                F.lit(patterns[n].description).alias("description"),
            )
            for n in numbers
        ]
        entries += [F.lit(name), F.array(*found)]
    lookup = F.create_map(*entries)
    return columns.select(
        "database_id",
        "table_name",
        "column_name",
        "column_ordinal",
        F.explode(F.try_element_at(lookup, F.lower("column_name"))).alias("p"),
    ).select("database_id", "table_name", "column_name", "column_ordinal", "p.*")


def schema_patterns(columns: DataFrame, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Patterns per table with their evidence columns in column order."""
    hits = pattern_hits(columns, patterns)
    return hits.groupBy(
        "database_id", "table_name", "pattern_ord", "pattern", "description"
    ).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("column_ordinal", "column_name"))),
            lambda c: c["column_name"],
        ).alias("evidence"),
        F.min("column_ordinal").alias("ordinal"),
    )


# ---------------------------------------------------------------- prompt text


def column_entry() -> Column:
    return F.concat(
        F.col("column_name"),
        F.lit(" ("),
        F.col("data_type"),
        F.lit(")"),
        F.when(F.col("is_primary_key"), F.lit(" PK")).otherwise(F.lit("")),
    )


def table_lines(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``  - table: [column (type) PK, …]`` for every table, also empty ones."""
    listed = columns.groupBy("database_id", "table_name").agg(
        joined_lines(["column_ordinal"], column_entry(), ", ").alias("listed")
    )
    return tables.join(listed, ["database_id", "table_name"], "left").select(
        "database_id",
        "table_ordinal",
        "table_name",
        F.concat(
            F.lit("  - "),
            F.col("table_name"),
            F.lit(": ["),
            F.coalesce("listed", F.lit("")),
            F.lit("]"),
        ).alias("line"),
    )


def table_listing(databases: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Listing text of every database, whole; "(no tables)" where there is none."""
    text = whole_text(
        table_lines(tables, columns), ["database_id"], "table_ordinal", F.col("line")
    )
    return _or_default(databases, text, "(no tables)")


def relationship_listing(databases: DataFrame, relationships: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("  - "), "from_table", F.lit("."), "from_column",
        F.lit(" → "), "to_table", F.lit("."), "to_column",
    )
    text = whole_text(relationships, ["database_id"], "rel_ordinal", line)
    return _or_default(databases, text, "(no relationships)")


def _or_default(databases: DataFrame, texts: DataFrame, default: str) -> DataFrame:
    return databases.select("database_id").join(texts, "database_id", "left").select(
        "database_id",
        F.lit(0).cast("bigint").alias("part_no"),
        F.coalesce("text", F.lit(default)).alias("text"),
    )


def column_batches(tables: DataFrame, size: int = TABLES_PER_BATCH) -> DataFrame:
    """Tables in groups of ``size``; table ordinals are dense, so no window is needed."""
    return tables.withColumn("batch_no", part_of("table_ordinal", size))


def column_batch_text(
    tables: DataFrame, columns: DataFrame, size: int = TABLES_PER_BATCH
) -> DataFrame:
    """Prompt text of every batch."""
    return column_batches(table_lines(tables, columns), size).groupBy(
        "database_id", "batch_no"
    ).agg(
        F.count(F.lit(1)).alias("tables_count"),
        joined_lines(["table_ordinal"], F.col("line"), "\n").alias("text"),
    )


def database_context(databases: DataFrame) -> DataFrame:
    unknown = F.lit("(unknown)")
    version = F.nullif(F.col("version"), F.lit(""))
    return databases.select(
        "database_id",
        F.concat(
            F.lit("Database: "),
            blank_to(F.col("name"), unknown),
            F.lit(" | "),
            blank_to(F.col("vendor"), unknown),
            F.coalesce(F.concat(F.lit(" | Version: "), version), F.lit("")),
        ).alias("context"),
    )


# -------------------------------------------------------------- model answers


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Answers whose JSON parses, as variants.  Others drop out: a failed call labels nothing."""
    return (
        answers.withColumn("body", F.try_parse_json(answer_json(F.col("answer"))))
        .filter(F.col("body").isNotNull())
        .drop("answer")
    )


def _map(body: str, path: str, kind: str = "map<string,string>") -> Column:
    return F.try_variant_get(body, f"$.{path}", kind)


def _entries(df: DataFrame, path: str, value: str, *keys: str) -> DataFrame:
    return df.select("database_id", *keys, F.explode(_map("body", path)).alias("table_name", value))


def table_labels(tables: DataFrame, parsed: DataFrame) -> DataFrame:
    """Descriptions, roles and domains of the table pass, merged per table."""
    first = parsed.filter(F.col("pass_no") == 1)
    labels = (
        _entries(first, "table_descriptions", "description")
        .unionByName(_entries(first, "business_roles", "business_role"), allowMissingColumns=True)
        .unionByName(_entries(first, "domains", "domain"), allowMissingColumns=True)
        .groupBy("database_id", "table_name")
        .agg(
            F.max("description").alias("description"),
            F.max("business_role").alias("business_role"),
            F.max("domain").alias("domain"),
        )
    )
    return tables.select("database_id", "table_name").join(
        labels, ["database_id", "table_name"], "left"
    )


def column_labels(parsed: DataFrame) -> DataFrame:
    """Column descriptions and types over all batches; the later batch wins."""
    second = parsed.filter(F.col("pass_no") == 2)
    described = second.select(
        "database_id",
        "batch_no",
        F.explode(_map("body", "column_descriptions", "map<string,map<string,string>>")).alias(
            "table_name", "by_column"
        ),
    ).select(
        "database_id", "batch_no", "table_name", F.explode("by_column").alias("column_name", "d")
    )
    typed = second.select(
        "database_id",
        "batch_no",
        F.explode(_map("body", "semantic_types")).alias("key", "s"),
    ).select(
        "database_id",
        "batch_no",
        F.substring_index("key", ".", 1).alias("table_name"),
        F.regexp_replace("key", r"^[^.]*\.", "").alias("column_name"),
        "s",
    )
    return (
        described.unionByName(typed, allowMissingColumns=True)
        .groupBy(*COLUMN_KEY)
        .agg(
            F.max_by("d", F.when(F.col("d").isNotNull(), F.col("batch_no"))).alias("description"),
            F.max_by("s", F.when(F.col("s").isNotNull(), F.col("batch_no"))).alias(
                "semantic_type"
            ),
        )
    )


def _third(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("pass_no") == 3)


def _items(parsed: DataFrame, path: str) -> DataFrame:
    items = F.try_variant_get("body", f"$.{path}", "array<variant>")
    return _third(parsed).select("database_id", F.posexplode(items).alias("ordinal", "item"))


def _text(path: str) -> Column:
    return F.coalesce(F.try_variant_get("item", f"$.{path}", "string"), F.lit(""))


def _is_object(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def entities(parsed: DataFrame) -> DataFrame:
    """Distinct entity names, placed by first occurrence; non-texts are skipped."""
    return (
        _items(parsed, "entities")
        .filter(F.schema_of_variant("item") == "STRING")
        .select("database_id", "ordinal", F.try_variant_get("item", "$", "string").alias("name"))
        .groupBy("database_id", "name")
        .agg(F.min("ordinal").cast("bigint").alias("ordinal"))
    )


def entity_relationships(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "entity_relationships").filter(_is_object(F.col("item"))).select(
        "database_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        _text("entity").alias("entity"),
        _text("related_entities").alias("related_entities"),
        _text("business_meaning").alias("business_meaning"),
    )


def use_cases(parsed: DataFrame) -> DataFrame:
    listed = F.try_variant_get("item", "$.involved_tables", "array<string>")
    return _items(parsed, "use_cases").filter(_is_object(F.col("item"))).select(
        "database_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        _text("name").alias("name"),
        _text("description").alias("description"),
        F.coalesce(F.array_join(listed, ", "), _text("involved_tables")).alias("involved_tables"),
    )


def sample_queries(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "sample_queries").filter(_is_object(F.col("item"))).select(
        "database_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        _text("question").alias("question"),
        _text("sql").alias("sql"),
        _text("category").alias("category"),
    )


def physical_relationships(relationships: DataFrame) -> DataFrame:
    return relationships.select(
        "database_id", "rel_ordinal", "from_table", "to_table", "from_column", "to_column"
    )


def section_sizes(databases: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """Items per section for every database; sections a database lacks are 0, not missing."""
    out = databases.select("database_id")
    for name, df in sections.items():
        sizes = df.groupBy("database_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(sizes, "database_id", "left")
    return out.select("database_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in sections])
