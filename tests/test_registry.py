"""Registered queries against their SQL twins, a quick part of them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = [
    "canonical_columns", "canonical_relationships", "rule_classify_columns", "schema_patterns",
    "column_batches", "catalog_counts", "relationship_names", "validation_status", "orphan_fk_rows",
    "hash_embeddings", "upsert_latest", "knn_topk", "neighbourhood", "grounded_items", "sql_audit",
    "insight_rows", "snapshot_delta", "changed_payloads", "browse_stats", "view_line_details",
    "ask_kpis", "stream_upsert", "stream_changes", "ddl_columns", "extract_sqlserver", "ddl_pieces_columns",
    "sql_audit_scoped", "table_listing", "business_processes", "schema_context", "join_paths_both_ends",
]


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "database_id"
