"""Relations of the catalog, and the shapes of the documents they come from.

Every relation starts with ``database_id``.  Ordinals are dense per database,
so that "first", "last" and "batches of N" need no window over a database.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# One raw metadata document.  ``nullable`` is a variant because only a JSON
# boolean counts; "YES", 0 or a missing key all mean nullable.
RAW_DOCUMENT = """
  database_type string, schema string, database_version string, version string,
  tables array<struct<
    table_name: string,
    columns: array<struct<column_name: string, data_type: string, nullable: variant>>,
    constraints: array<struct<constraint_name: string, constraint_type: string, column_name: string>>,
    relationships: array<struct<child_column: string, parent_table: string, parent_column: string>>>>,
  views array<struct<
    view_name: string, definition: string,
    columns: array<struct<column_name: string, data_type: string, nullable: variant>>>>
"""

# One enriched catalog document.
ENRICHED_DOCUMENT = """
  database_id bigint,
  metadata struct<source: string, database_type: string, database_name: string,
    database_version: string, tables_count: bigint, columns_count: bigint,
    views_count: bigint, relationships_count: bigint,
    quality_scores: struct<overall: string, completeness: string, relationships: string,
      naming: string, documentation: string, normalization: string>>,
  tables array<struct<ordinal: bigint, table_name: string, description: string,
    business_role: string, domain: string,
    columns: array<struct<column_name: string, data_type: string, is_nullable: boolean,
      is_primary_key: boolean, description: string, semantic_type: string>>>>,
  views array<struct<ordinal: bigint, view_name: string, definition: string,
    columns: array<struct<column_name: string, data_type: string, is_nullable: boolean>>>>,
  relationships array<struct<ordinal: bigint, name: string, description: string,
    from_table: string, from_column: string, to_table: string, to_column: string,
    child_table: string, child_column: string, parent_table: string, parent_column: string>>,
  entities array<struct<ordinal: bigint, name: string>>,
  entity_relationships array<struct<ordinal: bigint, entity: string,
    related_entities: string, business_meaning: string>>,
  business_processes array<struct<ordinal: bigint, domain: string, tables: string>>,
  use_cases array<struct<ordinal: bigint, name: string, description: string,
    involved_tables: string>>,
  sample_queries array<struct<ordinal: bigint, question: string, sql: string, category: string>>,
  schema_patterns array<struct<ordinal: bigint, pattern: string, table: string,
    evidence: string, description: string>>,
  validation_report array<struct<ordinal: bigint, severity: string, type: string,
    table: string, column: string, message: string>>
"""

ISSUE_COLUMNS = ["database_id", "severity", "type", "table_name", "column_name", "message"]


@dataclass(frozen=True)
class Catalog:
    """The structural relations of any number of databases."""

    databases: DataFrame
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    relationships: DataFrame
    views: DataFrame
    view_columns: DataFrame


@dataclass(frozen=True)
class Labels:
    """What rules and model answers add to a catalog."""

    table_labels: DataFrame
    column_labels: DataFrame
    entities: DataFrame
    entity_relationships: DataFrame
    use_cases: DataFrame
    sample_queries: DataFrame
