"""Text, keys and vectors of every schema object, and the keyed store of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.vectors import hash_embedding
from skemata.scale import whole_text

TABLE_KEY = ["database_id", "table_name"]
OBJECT_KEY = ["database_id", "object_key"]

# Fixed values in the texts below: line labels, key prefixes, True/False/None spellings.


def _shown(c: Column, missing: str = "None") -> Column:
    """A label that is present but null prints as None; one that is absent prints empty."""
    return F.coalesce(c.cast("string"), F.lit(missing))


def _flag(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _objects(df: DataFrame, kind: str, name: Column, key: Column, text: Column, meta: dict) -> DataFrame:
    return df.select(
        "database_id",
        F.lit(kind).alias("object_type"),
        name.alias("object_name"),
        key.alias("object_key"),
        text.alias("text_content"),
        F.create_map(
            *[x for n, c in meta.items() for x in (F.lit(n), c.cast("string"))]
        ).alias("metadata"),
    )


def table_objects(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One object per table; its text lists all its columns."""
    entry = _text(
        "  - ", F.col("column_name"), " (", F.col("data_type"), ")[",
        _shown(F.col("semantic_type")), "]: ", _shown(F.col("description")),
    )
    listed = whole_text(columns, TABLE_KEY, "position", entry)
    sizes = columns.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("column_count"))
    name = F.col("table_name")
    df = tables.join(listed, TABLE_KEY, "left").join(sizes, TABLE_KEY, "left")
    text = _text(
        "Table: ", name,
        "\nDescription: ", _shown(F.col("description")),
        "\nBusiness Role: ", _shown(F.col("business_role")),
        "\nDomain: ", _shown(F.col("domain")),
        "\nColumns:\n", F.coalesce("text", F.lit("")),
    )
    return _objects(
        df, "table", name, _text("table:", name), text,
        {
            "table_name": name,
            "description": F.col("description"),
            "business_role": F.col("business_role"),
            "domain": F.col("domain"),
            "column_count": F.coalesce("column_count", F.lit(0)),
        },
    )


def column_objects(columns: DataFrame) -> DataFrame:
    name = _text(F.col("table_name"), ".", F.col("column_name"))
    text = _text(
        "Column: ", name,
        "\nData Type: ", F.col("data_type"),
        "\nSemantic Type: ", _shown(F.col("semantic_type")),
        "\nDescription: ", _shown(F.col("description")),
        "\nPrimary Key: ", _flag(F.col("is_primary_key")),
        "\nNullable: ", _flag(F.col("is_nullable")),
    )
    return _objects(
        columns, "column", name, _text("column:", name), text,
        {
            "table_name": F.col("table_name"),
            "column_name": F.col("column_name"),
            "data_type": F.col("data_type"),
            "semantic_type": F.col("semantic_type"),
            "description": F.col("description"),
            "is_primary_key": F.col("is_primary_key"),
            "is_nullable": F.col("is_nullable"),
        },
    )


def relationship_objects(relationships: DataFrame) -> DataFrame:
    start = _text(F.col("from_table"), ".", F.col("from_column"))
    end = _text(F.col("to_table"), ".", F.col("to_column"))
    name = _text(start, "->", end)
    text = _text("Foreign Key: ", start, " -> ", end, "\nRelationship Type: foreign_key")
    return _objects(
        relationships, "relationship", name, _text("relationship:", name), text,
        {
            **{c: F.col(c) for c in ("from_table", "from_column", "to_table", "to_column")},
            "relationship_type": F.lit("foreign_key"),
        },
    )


def entity_relationship_objects(entity_relationships: DataFrame) -> DataFrame:
    entity = F.coalesce("entity", F.lit(""))
    related = F.coalesce("related_entities", F.lit(""))
    meaning = F.coalesce("business_meaning", F.lit(""))
    name = _text(entity, "->", related)
    text = _text(
        "Entity Relationship: ", entity, " -> ", related,
        "\nBusiness Meaning: ", meaning,
        "\nRelationship Type: entity_relationship",
    )
    return _objects(
        entity_relationships, "relationship", name, _text("entity_relationship:", name), text,
        {
            "entity": entity,
            "related_entities": related,
            "business_meaning": meaning,
            "relationship_type": F.lit("entity_relationship"),
        },
    )


def schema_objects(
    tables: DataFrame,
    columns: DataFrame,
    relationships: DataFrame,
    entity_relationships: DataFrame,
) -> DataFrame:
    return (
        table_objects(tables, columns)
        .unionByName(column_objects(columns))
        .unionByName(relationship_objects(relationships))
        .unionByName(entity_relationship_objects(entity_relationships))
    )


def embed(objects: DataFrame, vector: Column | None = None, text: str = "text_content") -> DataFrame:
    """Adds ``embedding``: by default the hash vector, else the given expression."""
    return objects.withColumn("embedding", hash_embedding(F.col(text)) if vector is None else vector)


def model_vector(encode: Callable[[Sequence[str]], Sequence[Sequence[float]]]):
    """Expression factory for a user's model: ``encode`` maps texts to vectors.

    Texts reach it in Arrow batches; an empty batch is not sent.
    """
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        if len(texts) == 0:
            return pd.Series([], dtype=object)
        return pd.Series([[float(x) for x in v] for v in encode(texts.tolist())])

    return run


# ------------------------------------------------------------------ keyed upsert


def latest_by_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key.  Rows of a hot key shrink to one per task first."""
    rest = [c for c in batch.columns if c not in keys]
    return (
        batch.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
        .select(*keys, "__last.*")
    )


def upsert(
    base: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    now: Column,
    keep: Sequence[str] = ("created_at",),
    touch: str = "updated_at",
) -> DataFrame:
    """New state of a keyed table: batch rows replace base rows, all else stays.

    The last batch row per key (by ``order``) wins.  ``keep`` columns survive an
    update; inserted rows take ``now`` for them, and for ``touch``.
    """
    stamps = [c for c in (*keep, touch) if c in base.columns]
    last = latest_by_key(
        batch.select(*keys, *[c for c in batch.columns if c not in (*keys, *stamps)]), keys, order
    )
    fields = [c for c in base.columns if c not in (*keys, *stamps)]
    new = last.select(
        *[F.col(k).alias(f"__n_{k}") for k in keys],
        *[F.col(c).alias(f"__n_{c}") for c in fields],
        F.lit(True).alias("__new"),
    )
    same = F.col(keys[0]) == F.col(f"__n_{keys[0]}")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"__n_{k}"))
    is_new = F.coalesce(F.col("__new"), F.lit(False))
    made: dict[str, Column] = {k: F.coalesce(k, f"__n_{k}") for k in keys}
    made.update({c: F.when(is_new, F.col(f"__n_{c}")).otherwise(F.col(c)) for c in fields})
    for c in stamps:
        if c == touch:
            made[c] = F.when(is_new, now).otherwise(F.col(c))
        else:
            made[c] = F.coalesce(c, now)
    return base.join(new, same, "full").select(*[made[c].alias(c) for c in base.columns])
