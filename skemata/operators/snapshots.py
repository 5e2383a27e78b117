"""Saved connections as a keyed snapshot table: hashes, deltas and updates.

Nothing is updated in place: an operator returns the new state, or only the
rows to append.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.jsontext import canonical_json, content_hash
from skemata.scale import skew_join

# Sections of an insight category, and the page sizes.
ITEM_SECTIONS = ["kpis", "insights", "opportunities", "art_of_the_possible"]
LIST_LIMIT, SEARCH_LIMIT = 50, 20


def deterministic_id(*parts: Column) -> Column:
    """A positive id from content, the same in every run."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def payload_hash(payload: Column) -> Column:
    """SHA-256 of JSON text in one spelling: parsed and written with sorted keys."""
    return F.sha2(F.coalesce(F.try_parse_json(payload).cast("string"), payload, F.lit("{}")), 256)


def item_hashes(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    return items.withColumn("item_hash", content_hash({f: F.col(f) for f in fields}))


def new_connections(rows: DataFrame, now: Column) -> DataFrame:
    """Rows to append, with defaults, a key from vendor and name, and the hash."""
    given = set(rows.columns)

    def field(name: str, default: str | None) -> Column:
        value = F.col(name) if name in given else F.lit(None).cast("string")
        return (F.coalesce(value, F.lit(default)) if default is not None else value).alias(name)

    insights = field("insights", "{}")
    return rows.select(
        (F.col("id") if "id" in given else deterministic_id(F.col("database_type"), F.col("name"))).alias("id"),
        "name",
        field("description", None),
        "database_type",
        field("enriched_schema", "{}"),
        insights,
        payload_hash(insights).alias("insights_hash"),
        field("status", "active"),
        field("error_message", None),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def _count(section: str) -> Column:
    return F.coalesce(
        F.json_array_length(F.get_json_object("enriched_schema", f"$.{section}")), F.lit(0)
    )


def summaries(connections: DataFrame) -> DataFrame:
    """Light rows without payloads."""
    return connections.select(
        "id",
        "name",
        "description",
        "database_type",
        "status",
        _count("tables").alias("table_count"),
        _count("views").alias("view_count"),
        "created_at",
        "updated_at",
    )


def list_connections(
    connections: DataFrame,
    status: str | None = None,
    database_type: str | None = None,
    limit: int = LIST_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """One page of summaries, newest first."""
    if status:
        connections = connections.filter(F.col("status") == status)
    if database_type:
        connections = connections.filter(F.col("database_type") == database_type)
    page = connections.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)
    return summaries(page)


def search_connections(
    connections: DataFrame, text: str, limit: int = SEARCH_LIMIT, offset: int = 0
) -> DataFrame:
    """Name or description contains the text; exact, then prefix, then inner hits.

    ``%`` and ``_`` in the text act as wildcards.
    """
    name = F.col("name")
    inner = f"%{text}%"
    place = (
        F.when(name.ilike(text), F.lit(0))
        .when(name.ilike(f"{text}%"), F.lit(1))
        .when(name.ilike(inner), F.lit(2))
        .otherwise(F.lit(3))
    )
    hits = connections.filter(name.ilike(inner) | F.col("description").ilike(inner))
    page = hits.withColumn("match_rank", place).orderBy(
        "match_rank", F.col("created_at").desc(), "id"
    ).offset(offset).limit(limit)
    return summaries(page)


def get_connection(connections: DataFrame, connection_id) -> DataFrame:
    return connections.filter(F.col("id") == connection_id)


def without(connections: DataFrame, deleted: DataFrame) -> DataFrame:
    """State after deletes; ``deleted`` holds ids."""
    return connections.join(deleted.select("id").distinct(), "id", "left_anti")


def delete_report(connections: DataFrame, deleted: DataFrame) -> DataFrame:
    """Whether each id to delete existed."""
    there = connections.select("id", F.lit(True).alias("found"))
    return deleted.select("id").distinct().join(there, "id", "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("deleted")
    )


PATCHABLE = ["name", "description", "status", "error_message"]


def one_per_id(rows: DataFrame, fields: Sequence[str], order: str | None) -> DataFrame:
    """Last given value of each field per id.

    Several rows of an id count in the order of ``order``, of equal or no order in that
    of their values; a null field leaves what an earlier row gave.
    """
    place = F.col(order) if order else F.lit(0)
    last = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(place.alias("o"), F.col(c).alias("v"))))["v"].alias(c)
        for c in fields
    ]
    return rows.groupBy("id").agg(*last)


def patch(
    connections: DataFrame, patches: DataFrame, now: Column, order: str | None = None
) -> DataFrame:
    """Partial update: given fields replace, null fields leave as is, empty patches do nothing.

    Several patches of an id apply one after the other, by ``order``.
    """
    fields = [c for c in PATCHABLE if c in patches.columns]
    new = one_per_id(patches, fields, order).select(
        "id", *[F.col(c).alias(f"__n_{c}") for c in fields]
    )
    touched = F.lit(False)
    for c in fields:
        touched = touched | F.col(f"__n_{c}").isNotNull()
    out = {c: F.coalesce(f"__n_{c}", c) for c in fields}
    out["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    return connections.join(new, "id", "left").select(
        *[out.get(c, F.col(c)).alias(c) for c in connections.columns]
    )


def refresh_schema(
    connections: DataFrame,
    schemas: DataFrame,
    now: Column,
    clear_insights: bool = True,
    order: str | None = None,
) -> DataFrame:
    """New schema per id, the last one by ``order``.  A refresh also clears insights,
    hash and error, and activates."""
    hit = F.col("__schema").isNotNull()
    out = {
        "enriched_schema": F.coalesce("__schema", "enriched_schema"),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    if clear_insights:
        null = F.lit(None).cast("string")
        out["insights"] = F.when(hit, F.lit("{}")).otherwise(F.col("insights"))
        out["insights_hash"] = F.when(hit, null).otherwise(F.col("insights_hash"))
        out["status"] = F.when(hit, F.lit("active")).otherwise(F.col("status"))
        out["error_message"] = F.when(hit, null).otherwise(F.col("error_message"))
    new = one_per_id(schemas, ["enriched_schema"], order).select(
        "id", F.col("enriched_schema").alias("__schema")
    )
    return connections.join(new, "id", "left").select(
        *[out.get(c, F.col(c)).alias(c) for c in connections.columns]
    )


def changed_payloads(
    connections: DataFrame, payloads: DataFrame, order: str | None = None
) -> DataFrame:
    """Payloads (id, insights), the last of each id by ``order``, whose hash differs from
    the stored one; others need no write."""
    new = one_per_id(payloads, ["insights"], order).select("id", "insights", payload_hash(F.col("insights")).alias("insights_hash"))
    old = connections.select("id", F.col("insights_hash").alias("__old"))
    return new.join(old, "id").filter(~F.col("insights_hash").eqNullSafe(F.col("__old"))).drop("__old")


def write_payloads(
    connections: DataFrame, payloads: DataFrame, now: Column, order: str | None = None
) -> DataFrame:
    """New state; rows with an unchanged hash keep all their values."""
    changed = changed_payloads(connections, payloads, order).select(
        "id", F.col("insights").alias("__i"), F.col("insights_hash").alias("__h")
    )
    hit = F.col("__h").isNotNull()
    out = {
        "insights": F.coalesce("__i", "insights"),
        "insights_hash": F.coalesce("__h", "insights_hash"),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return connections.join(changed, "id", "left").select(
        *[out.get(c, F.col(c)).alias(c) for c in connections.columns]
    )


# ----------------------------------------------------------------------- deltas


def item_delta(old: DataFrame, new: DataFrame, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Change of each item, by content hash within ``keys``.

    New rows come out ``unchanged`` or ``added``, in their own order and with
    their repeats; hashes only in the old list come out ``removed``, once.
    """
    on = [*keys, "item_hash"]
    had = old.select(*on).distinct().withColumn("__had", F.lit(True))
    now = new.select(*on, ordinal)
    kept = skew_join(now, had, on, "left", [ordinal]).select(
        *on,
        ordinal,
        F.when(F.col("__had"), F.lit("unchanged")).otherwise(F.lit("added")).alias("change"),
    )
    gone = had.drop("__had").join(new.select(*on).distinct(), on, "left_anti")
    return kept.unionByName(
        gone.select(*on, F.lit(None).cast(new.schema[ordinal].dataType).alias(ordinal), F.lit("removed").alias("change"))
    )


def changed_sections(old: DataFrame, new: DataFrame, keys: Sequence[str], section: str = "section", ordinal: str = "ordinal") -> DataFrame:
    """Sections whose list differs in any place, per key.

    Lists are compared place by place in a full join, never collected.
    """
    on = [*keys, section, ordinal]
    a = old.select(*on, F.col("item_hash").alias("__a"))
    b = new.select(*on, F.col("item_hash").alias("__b"))
    return (
        a.join(b, on, "full")
        .groupBy(*keys, section)
        .agg(F.bool_or(~F.col("__a").eqNullSafe(F.col("__b"))).alias("differs"))
        .groupBy(*keys)
        .agg(F.count_if("differs").alias("changed_sections"))
    )


def merge_categories(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("connection_id", "category")) -> DataFrame:
    """New categories replace old ones; categories not generated again stay."""
    generated = new.select(*keys).distinct()
    return skew_join(old, generated, list(keys), "left_anti", ["item_hash"]).unionByName(new)


# --------------------------------------------------------------------- failures


def capture_failures(texts: DataFrame, text: str = "document") -> DataFrame:
    """Raw documents with a status; what fails keeps its text and says why."""
    body = F.try_parse_json(text)
    tables = F.try_variant_get(body, "$.tables", "array<variant>")
    problem = (
        F.when(F.col(text).isNull() | (F.trim(text) == ""), F.lit("document is empty"))
        .when(body.isNull(), F.lit("document is not valid JSON"))
        .when(~F.schema_of_variant(body).startswith("OBJECT"), F.lit("document is not an object"))
        .when(
            F.try_variant_get(body, "$.tables", "variant").isNotNull() & tables.isNull(),
            F.lit("tables is not a list"),
        )
    )
    return texts.withColumn("error_message", problem).select(
        *texts.columns,
        F.when(F.col("error_message").isNull(), F.lit("active")).otherwise(F.lit("error")).alias("status"),
        "error_message",
    )
