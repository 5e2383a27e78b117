"""Raw metadata documents to relations.

Everything about one table sits inside its document, so keys and flags are
resolved with array functions in the row: no shuffle, and the same code runs on
a stream of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.text import blank_to
from skemata.schemas import Catalog


def json_boolean_or_true(value: Column) -> Column:
    """A JSON boolean keeps its value; anything else, or nothing, is true."""
    is_boolean = F.schema_of_variant(value) == "BOOLEAN"
    return F.coalesce(
        F.when(is_boolean, F.try_variant_get(value, "$", "boolean")), F.lit(True)
    )


def _columns_of(table: Column) -> Column:
    keys = F.transform(
        F.filter(
            table["constraints"], lambda c: F.upper(c["constraint_type"]) == "PRIMARY KEY"
        ),
        lambda c: c["column_name"],
    )
    return F.transform(
        F.coalesce(table["columns"], F.array()),
        lambda c, i: F.struct(
            i.cast("bigint").alias("position"),
            c["column_name"].alias("column_name"),
            c["data_type"].alias("data_type"),
            json_boolean_or_true(c["nullable"]).alias("is_nullable"),
            F.coalesce(F.array_contains(keys, c["column_name"]), F.lit(False)).alias(
                "is_primary_key"
            ),
        ),
    )


def _relationships_of(table: Column) -> Column:
    named = F.filter(
        table["constraints"],
        lambda c: (F.upper(c["constraint_type"]) == "FOREIGN KEY")
        & (F.coalesce(c["constraint_name"], F.lit("")) != ""),
    )

    def last_name(child: Column) -> Column:
        mine = F.filter(named, lambda c: c["column_name"] == child)
        return F.get(mine, F.size(mine) - 1)["constraint_name"]

    return F.transform(
        F.coalesce(table["relationships"], F.array()),
        lambda r: F.struct(
            table["table_name"].alias("from_table"),
            r["child_column"].alias("from_column"),
            r["parent_table"].alias("to_table"),
            r["parent_column"].alias("to_column"),
            last_name(r["child_column"]).alias("constraint_name"),
        ),
    )


def _flat(documents: DataFrame, arrays: Column, ordinal: str) -> DataFrame:
    """Rows of an array of arrays, numbered densely over the whole document."""
    return documents.select(
        "database_id", F.posexplode(F.flatten(arrays)).alias(ordinal, "r")
    ).select("database_id", F.col(ordinal).cast("bigint").alias(ordinal), "r.*")


def database_info(documents: DataFrame) -> DataFrame:
    return documents.select(
        "database_id",
        F.col("database_type").alias("vendor"),
        F.col("schema").alias("name"),
        blank_to(F.col("database_version"), F.col("version")).alias("version"),
    )


def canonicalise(documents: DataFrame) -> Catalog:
    """``documents``: ``database_id`` plus the fields of a raw document."""
    tables = F.coalesce(F.col("tables"), F.array())
    views = F.coalesce(F.col("views"), F.array())
    return Catalog(
        databases=database_info(documents),
        tables=documents.select(
            "database_id", F.posexplode(tables).alias("table_ordinal", "t")
        ).select(
            "database_id",
            F.col("table_ordinal").cast("bigint").alias("table_ordinal"),
            F.col("t.table_name").alias("table_name"),
            F.lit("TABLE").alias("table_type"),
        ),
        columns=_flat(
            documents,
            F.transform(
                tables,
                lambda t, i: F.transform(
                    _columns_of(t),
                    lambda c: F.struct(
                        i.cast("bigint").alias("table_ordinal"),
                        t["table_name"].alias("table_name"),
                        *[
                            c[f].alias(f)
                            for f in (
                                "position",
                                "column_name",
                                "data_type",
                                "is_nullable",
                                "is_primary_key",
                            )
                        ],
                    ),
                ),
            ),
            "column_ordinal",
        ),
        constraints=_flat(
            documents,
            F.transform(
                tables,
                lambda t: F.transform(
                    F.coalesce(t["constraints"], F.array()),
                    lambda c: F.struct(
                        t["table_name"].alias("table_name"),
                        c["constraint_name"].alias("constraint_name"),
                        F.upper(F.coalesce(c["constraint_type"], F.lit(""))).alias(
                            "constraint_type"
                        ),
                        c["column_name"].alias("column_name"),
                    ),
                ),
            ),
            "constraint_ordinal",
        ),
        relationships=_flat(documents, F.transform(tables, _relationships_of), "rel_ordinal"),
        views=documents.select(
            "database_id", F.posexplode(views).alias("view_ordinal", "v")
        ).select(
            "database_id",
            F.col("view_ordinal").cast("bigint").alias("view_ordinal"),
            F.col("v.view_name").alias("view_name"),
            F.coalesce("v.definition", F.lit("")).alias("definition"),
        ),
        view_columns=_flat(
            documents,
            F.transform(
                views,
                lambda v: F.transform(
                    F.coalesce(v["columns"], F.array()),
                    lambda c, i: F.struct(
                        v["view_name"].alias("view_name"),
                        i.cast("bigint").alias("position"),
                        c["column_name"].alias("column_name"),
                        F.coalesce(c["data_type"], F.lit("unknown")).alias("data_type"),
                        json_boolean_or_true(c["nullable"]).alias("is_nullable"),
                    ),
                ),
            ),
            "view_column_ordinal",
        ),
    )


ENDS = (
    ("from_table", "child_table"),
    ("from_column", "child_column"),
    ("to_table", "parent_table"),
    ("to_column", "parent_column"),
)


def normalise_relationship_keys(rels: DataFrame, mode: str = "truthy") -> DataFrame:
    """child/parent spelling to from/to.

    ``truthy``: an empty value falls through to the other spelling;
    ``present``: the from/to spelling is used for the whole row as soon as
    ``from_table`` is there, even when it is empty.
    """
    if mode not in ("truthy", "present"):
        raise ValueError(f"unknown mode: {mode}")
    picked = []
    for new, old in ENDS:
        given = F.col(new)
        if mode == "truthy":
            picked.append(F.coalesce(F.nullif(given, F.lit("")), F.col(old), F.lit("")).alias(new))
        else:
            picked.append(
                F.when(F.col("from_table").isNotNull(), given)
                .otherwise(F.coalesce(F.col(old), F.lit("")))
                .alias(new)
            )
    names = {n for pair in ENDS for n in pair}
    return rels.select(*[c for c in rels.columns if c not in names], *picked)


def parse_arrow_relationships(rels: DataFrame, text: str = "description") -> DataFrame:
    """Ends from ``child.column → parent.column`` text; other texts give no row."""
    sides = F.split(text, " → ")

    def piece(side: int, part: int) -> Column:
        return F.get(F.split(F.get(sides, F.lit(side)), r"\."), F.lit(part))

    return rels.filter(F.col(text).contains(" → ")).select(
        *rels.columns,
        piece(0, 0).alias("child_table"),
        piece(0, 1).alias("child_column"),
        piece(1, 0).alias("parent_table"),
        piece(1, 1).alias("parent_column"),
    )


def is_enriched(metadata: Column, tables: Column, database_type: Column) -> Column:
    """A document is enriched when it has metadata and tables but no vendor at its root."""
    return metadata.isNotNull() & tables.isNotNull() & (F.coalesce(database_type, F.lit("")) == "")


def flagged_columns(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """PK and FK flags from constraints (exact, upper-case types), one pass over constraints."""
    flags = constraints.groupBy("database_id", "table_name", "column_name").agg(
        F.bool_or(F.col("constraint_type") == "PRIMARY KEY").alias("pk"),
        F.bool_or(F.col("constraint_type") == "FOREIGN KEY").alias("fk"),
    )
    kept = [c for c in columns.columns if c not in ("is_primary_key", "is_foreign_key")]
    return columns.join(flags, ["database_id", "table_name", "column_name"], "left").select(
        *kept,
        F.coalesce("pk", F.lit(False)).alias("is_primary_key"),
        F.coalesce("fk", F.lit(False)).alias("is_foreign_key"),
    )


def flagged_from_relationships(columns: DataFrame, relationships: DataFrame) -> DataFrame:
    """FK flag of enriched columns: some relationship leaves from the column."""
    leaving = relationships.select(
        "database_id",
        F.col("from_table").alias("table_name"),
        F.col("from_column").alias("column_name"),
        F.lit(True).alias("fk"),
    ).distinct()
    return columns.join(leaving, ["database_id", "table_name", "column_name"], "left").select(
        *[c for c in columns.columns if c != "is_foreign_key"],
        F.coalesce("fk", F.lit(False)).alias("is_foreign_key"),
    )


def rebuilt_constraints(flagged: DataFrame) -> DataFrame:
    """Constraints of enriched tables, remade from the column flags."""

    def one(prefix: str, kind: str, flag: str) -> Column:
        return F.when(
            F.col(flag),
            F.struct(
                F.concat(
                    F.lit(prefix), F.col("table_name"), F.lit("_"), F.col("column_name")
                ).alias("constraint_name"),
                F.lit(kind).alias("constraint_type"),
            ),
        )

    both = F.array(
        one("pk_", "PRIMARY KEY", "is_primary_key"), one("fk_", "FOREIGN KEY", "is_foreign_key")
    )
    return flagged.select(
        "database_id",
        "table_name",
        "column_name",
        F.explode(F.filter(both, lambda c: c.isNotNull())).alias("c"),
    ).select("database_id", "table_name", "column_name", "c.*")


def relationship_display_names(relationships: DataFrame) -> DataFrame:
    """Constraint name, else ``fk_<table>_<column>``."""
    return relationships.withColumn(
        "name",
        blank_to(
            F.col("constraint_name"),
            F.concat(F.lit("fk_"), F.col("from_table"), F.lit("_"), F.col("from_column")),
        ),
    )


def inbound_references(relationships: DataFrame) -> DataFrame:
    """Who refers to each table: one row per reference, led by the parent table.

    Rows, not one array per parent: a hub table may be referred to by a large
    share of all foreign keys.
    """
    return relationships.select(
        "database_id",
        F.col("to_table").alias("table_name"),
        F.col("from_table").alias("child_table"),
        F.col("from_column").alias("child_column"),
        F.col("to_column").alias("parent_column"),
    )
