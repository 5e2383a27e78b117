"""Browsing catalogs: counts, name search, column details, log tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Log levels by rank.
LEVELS = {"NOTSET": 0, "DEBUG": 10, "INFO": 20, "WARNING": 30, "WARN": 30, "ERROR": 40, "CRITICAL": 50}
LOG_LINES = 200


def overview(
    databases: DataFrame,
    tables: DataFrame,
    views: DataFrame,
    flagged: DataFrame,
    relationships: DataFrame,
    constraints: DataFrame,
) -> DataFrame:
    """Counts per database: one union of partial counts and one shuffle.

    ``flagged``: columns with is_primary_key and is_foreign_key.
    """
    names = [
        "total_tables", "total_views", "total_columns", "total_relationships",
        "total_constraints", "total_pks", "total_fks",
    ]

    def ones(df: DataFrame, **hot) -> DataFrame:
        return df.select("database_id", *[hot.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    rows = ones(databases)
    for more in (
        ones(tables, total_tables=one),
        ones(views, total_views=one),
        ones(
            flagged,
            total_columns=one,
            total_pks=F.col("is_primary_key").cast("int"),
            total_fks=F.col("is_foreign_key").cast("int"),
        ),
        ones(relationships, total_relationships=one),
        ones(constraints, total_constraints=one),
    ):
        rows = rows.unionAll(more)
    return rows.groupBy("database_id").agg(*[F.sum(n).alias(n) for n in names])


def search_names(tables: DataFrame, views: DataFrame, text: str) -> DataFrame:
    """Tables and views whose name contains the text in any case."""
    low = text.lower()
    named = tables.select("database_id", F.lit("table").alias("kind"), F.col("table_name").alias("name")).unionAll(
        views.select("database_id", F.lit("view"), "view_name")
    )
    return named.filter(F.lower("name").contains(low))


def search_connections(connections: DataFrame, text: str) -> DataFrame:
    """Name, description or vendor contains the text in any case."""
    low = text.lower()
    hit = F.lit(False)
    for c in ("name", "description", "database_type"):
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return connections.filter(hit)


def column_details(columns: DataFrame, constraints: DataFrame, relationships: DataFrame) -> DataFrame:
    """Constraints, outgoing references and flags of every column.

    Both sides are grouped by column first; a column has few of either.
    """
    key = ["database_id", "table_name", "column_name"]
    own = constraints.groupBy(*key).agg(
        F.bool_or(F.col("constraint_type") == "PRIMARY KEY").alias("pk"),
        F.bool_or(F.col("constraint_type") == "FOREIGN KEY").alias("fk"),
        F.count(F.lit(1)).alias("n_constraints"),
        F.array_join(F.array_sort(F.collect_list(F.concat(
            F.coalesce("constraint_name", F.lit("")), F.lit(":"), "constraint_type"))), ", ").alias("constraints"),
    )
    out = relationships.groupBy(
        "database_id", F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name")
    ).agg(
        F.count(F.lit(1)).alias("n_references"),
        F.array_join(F.array_sort(F.collect_list(F.concat("to_table", F.lit("."), "to_column"))), ", ").alias("references"),
    )
    no, zero, empty = F.lit(False), F.lit(0), F.lit("")
    return columns.select(*key).join(own, key, "left").join(out, key, "left").select(
        *key,
        F.coalesce("pk", no).alias("is_pk"),
        F.coalesce("fk", no).alias("is_fk"),
        F.coalesce("constraints", empty).alias("constraints"),
        F.coalesce("references", empty).alias("references"),
        (F.coalesce("n_constraints", zero) + F.coalesce("n_references", zero) > 0).alias("has_details"),
    )


def log_tail(
    log: DataFrame, lines: int = LOG_LINES, level: str = "DEBUG", capacity: int | None = None
) -> DataFrame:
    """Last lines at or above a level, of the whole log.

    ``log``: seq, level, message.  ``capacity``, if given, looks at that many last
    entries only, as a rolling buffer of that size does.  Both limits are top-k plans.
    """
    least = LEVELS.get(level.upper(), LEVELS["DEBUG"])
    ranks = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    if capacity is not None:
        log = log.orderBy(F.col("seq").desc()).limit(capacity)
    kept = log.filter(F.try_element_at(ranks, F.upper("level")) >= least)
    return kept.orderBy(F.col("seq").desc()).limit(lines).orderBy("seq")


def ready_for_insights(connections: DataFrame) -> DataFrame:
    """Active connections whose schema has at least one table."""
    tables = F.coalesce(
        F.json_array_length(F.get_json_object("enriched_schema", "$.tables")), F.lit(0)
    )
    return connections.filter((F.col("status") == "active") & (tables > 0))
