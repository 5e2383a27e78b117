"""Enriched relations and enriched documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.names import describe_relationship, phrase, phrase_words, singular
from skemata.functions.text import compact, strip
from skemata.scale import skew_join, whole_text
from skemata.schemas import Catalog

TABLE_KEY = ["database_id", "table_name"]
COLUMN_KEY = ["database_id", "table_name", "column_name"]


def catalog_counts(catalog: Catalog) -> DataFrame:
    """Tables, columns, views and relationships per database.

    Each relation is counted before it meets the others: one union of partial
    counts, one shuffle, and no row is multiplied.
    """
    names = ["tables_count", "columns_count", "views_count", "relationships_count"]
    relations = [catalog.tables, catalog.columns, catalog.views, catalog.relationships]

    def ones(df: DataFrame, hot: str | None) -> DataFrame:
        return df.select(
            "database_id", *[F.lit(1 if n == hot else 0).alias(n) for n in names]
        )

    rows = ones(catalog.databases, None)
    for name, df in zip(names, relations):
        rows = rows.unionAll(ones(df, name))
    return rows.groupBy("database_id").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def enrich_tables(tables: DataFrame, labels: DataFrame) -> DataFrame:
    return tables.join(
        labels.select(*TABLE_KEY, "description", "business_role", "domain"), TABLE_KEY, "left"
    )


def enrich_columns(columns: DataFrame, labels: DataFrame) -> DataFrame:
    return columns.join(
        labels.select(*COLUMN_KEY, "description", "semantic_type"), COLUMN_KEY, "left"
    )


def view_sections(view_columns: DataFrame) -> DataFrame:
    return view_columns.select(
        "database_id", "view_name", "position", "column_name", "data_type", "is_nullable"
    )


# --------------------------------------------------------------- relationships


def entity_pair_lookup(entity_relationships: DataFrame) -> DataFrame:
    """(child, parent) in compact spelling to meaning and entity; the last one wins."""
    entity = strip(F.coalesce("entity", F.lit("")))
    meaning = F.coalesce("business_meaning", F.lit(""))
    return (
        entity_relationships.filter((entity != "") & (meaning != ""))
        .select(
            "database_id",
            "ordinal",
            entity.alias("entity"),
            meaning.alias("meaning"),
            F.posexplode(F.split(F.coalesce("related_entities", F.lit("")), ",")).alias("n", "r"),
        )
        .withColumn("r", strip(F.col("r")))
        .filter("r <> ''")
        .groupBy(
            "database_id",
            compact(F.col("entity")).alias("child"),
            compact(F.col("r")).alias("parent"),
        )
        .agg(
            F.max_by(F.struct("meaning", "entity"), F.struct("ordinal", "n")).alias("pair")
        )
        .select("database_id", "child", "parent", "pair.*")
    )


def name_relationships(relationships: DataFrame, entity_relationships: DataFrame) -> DataFrame:
    """Adds a verb-phrase ``name`` and a ``description`` sentence.

    A meaning the model gave for the entity pair comes first, in either
    direction; otherwise a sentence is made from the names.  Both spellings of
    the ends are kept.
    """
    pairs = entity_pair_lookup(entity_relationships)
    ends = relationships.withColumns(
        {
            "__c": compact(singular(F.col("from_table"))),
            "__p": compact(singular(F.col("to_table"))),
        }
    )

    def look_up(df: DataFrame, child: str, parent: str, prefix: str) -> DataFrame:
        named = pairs.select(
            "database_id",
            F.col("child").alias(child),
            F.col("parent").alias(parent),
            F.col("meaning").alias(f"{prefix}_meaning"),
            F.col("entity").alias(f"{prefix}_entity"),
        )
        # all keys of a hub pair look the same, so they may be hot
        return skew_join(
            df, named, ["database_id", child, parent], "left", ["rel_ordinal"]
        )

    both = look_up(look_up(ends, "__c", "__p", "f"), "__p", "__c", "b")
    # staged, so that no sentence is made or taken apart twice
    staged = (
        both.withColumns(
            {
                "__meaning": F.coalesce("f_meaning", "b_meaning"),
                "__entity": F.when(F.col("f_meaning").isNotNull(), F.col("f_entity")).otherwise(
                    F.col("b_entity")
                ),
                "__made": describe_relationship(
                    F.col("from_table"),
                    F.col("from_column"),
                    F.col("to_table"),
                    F.col("to_column"),
                ),
            }
        )
        .withColumn(
            "__words",
            F.when(
                F.col("__meaning").isNotNull(),
                phrase_words(F.col("__meaning"), F.col("__entity")),
            ).otherwise(phrase_words(F.col("__made"))),
        )
    )
    return staged.select(
        *relationships.columns,
        phrase(F.col("__words")).alias("name"),
        F.coalesce("__meaning", "__made").alias("description"),
        F.col("from_table").alias("child_table"),
        F.col("from_column").alias("child_column"),
        F.col("to_table").alias("parent_table"),
        F.col("to_column").alias("parent_column"),
    )


# -------------------------------------------------------------------- sections


DOMAIN_KEY = ["database_id", "domain"]


def business_processes(tables: DataFrame) -> DataFrame:
    """The tables of each domain, one row per table.

    ``first_seen`` keeps the order in which domains appear.
    """
    inside = tables.filter(F.col("domain").isNotNull()).select(*DOMAIN_KEY, "table_ordinal", "table_name")
    seen = inside.groupBy(*DOMAIN_KEY).agg(F.min("table_ordinal").alias("first_seen"))
    return skew_join(inside, seen, DOMAIN_KEY, "inner", ["table_ordinal"])


def process_texts(processes: DataFrame) -> DataFrame:
    """One text per domain of ``business_processes``, as a document and a prompt hold it."""
    texts = whole_text(processes, [*DOMAIN_KEY, "first_seen"], "table_ordinal", F.col("table_name"), ", ")
    return texts.select(*DOMAIN_KEY, F.col("first_seen").alias("ordinal"), F.col("text").alias("tables"))


def pattern_section(patterns: DataFrame, *more: str) -> DataFrame:
    return patterns.select(
        "database_id",
        *more,
        "pattern",
        F.col("table_name").alias("table"),
        F.array_join("evidence", ", ").alias("evidence"),
        "description",
    )


def issue_section(issues: DataFrame, *more: str) -> DataFrame:
    return issues.select(
        "database_id",
        *more,
        F.coalesce("severity", F.lit("INFO")).alias("severity"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("table_name", F.lit("")).alias("table"),
        F.coalesce("column_name", F.lit("")).alias("column"),
        F.coalesce("message", F.lit("")).alias("message"),
    )


def display_score(score: Column) -> Column:
    """``0.876`` as ``87/100``, truncated."""
    return F.concat((score * 100).cast("int").cast("string"), F.lit("/100"))


def metadata_section(databases: DataFrame, counts: DataFrame, scores: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = {
        "overall": "overall_score",
        "completeness": "completeness",
        "relationships": "relationships",
        "naming": "naming_convention",
        "documentation": "documentation",
        "normalization": "normalization",
    }
    return (
        databases.join(counts, "database_id", "left")
        .join(scores, "database_id", "left")
        .select(
            "database_id",
            F.struct(
                F.lit("raw_metadata.json").alias("source"),
                text(F.col("vendor")).alias("database_type"),
                text(F.col("name")).alias("database_name"),
                text(F.col("version")).alias("database_version"),
                "tables_count",
                "columns_count",
                "views_count",
                "relationships_count",
                F.struct(
                    *[display_score(F.col(src)).alias(out) for out, src in shown.items()]
                ).alias("quality_scores"),
            ).alias("metadata"),
        )
    )


def document_items(metadata: DataFrame, sections: Mapping[str, DataFrame]) -> DataFrame:
    """Enriched documents as rows at any size: one per item of a section, and one for the
    metadata.

    ``sections`` maps a section name to rows made by ``section``.  A row has the place of
    its item (``section, lead, ordinal``) and the item in the column of its section.
    """
    zero = F.lit(0).cast("bigint")
    rows = metadata.select(
        "database_id", F.lit("metadata").alias("section"), zero.alias("lead"), zero.alias("ordinal"), "metadata"
    )
    for name, df in sections.items():
        item = F.struct("ordinal", "item.*").alias(name)
        rows = rows.unionByName(
            df.select("database_id", F.lit(name).alias("section"), "lead", "ordinal", item),
            allowMissingColumns=True,
        )
    return rows


def assemble_documents(items: DataFrame) -> DataFrame:
    """One nested document per database from ``document_items``, by one grouping.

    A document is one value, so this is for databases whose catalog fits a row; items
    serve those of any size.
    """
    names = items.columns[5:]

    def listed(name: str) -> Column:
        mine = F.when(F.col("section") == name, F.struct("lead", F.col(name).alias("row")))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda r: r["row"]).alias(name)

    return items.groupBy("database_id").agg(
        F.first("metadata", ignorenulls=True).alias("metadata"), *[listed(n) for n in names]
    )


def section(df: DataFrame, ordinal: str, *fields: str, lead: str | None = None) -> DataFrame:
    """Shape a relation for ``document_items``.

    ``ordinal`` places an item; ``lead`` comes before it in the order.
    """
    return df.select(
        "database_id",
        F.col(ordinal).cast("bigint").alias("ordinal"),
        (F.col(lead) if lead else F.lit(0)).cast("bigint").alias("lead"),
        F.struct(*fields).alias("item"),
    )
