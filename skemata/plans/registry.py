"""Registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# schemas by session and path, so that a table's footers are read once
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


# rows by session and path, read from a table's footers
_ROWS: dict[tuple[str, str], int] = {}


def row_count(spark: SparkSession, sf: str, name: str) -> int:
    """About how many rows a table has, to deal them to tasks by; a path is counted once."""
    key = (spark.sparkContext.applicationId, f"{sf}/{name}.parquet")
    if key not in _ROWS:
        _ROWS[key] = read(spark, sf, name).count()
    return _ROWS[key]


def load() -> dict[str, Query]:
    """All queries; importing the modules registers them."""
    from skemata.plans import (  # noqa: F401
        catalog_queries,
        data_queries,
        graph_queries,
        source_queries,
        text_queries,
    )

    return QUERIES
