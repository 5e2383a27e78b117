"""Context text for insight generation, and generated insights as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.text import filled
from skemata.scale import joined_lines, whole_text

TABLE_KEY = ["database_id", "table_name"]

# Categories, and the fields of each kind of item.
CATEGORIES = ["Overview", "Operations", "Finance", "Marketing", "Sales", "Human Resources", "IT"]
SECTIONS: dict[str, list[str]] = {
    "kpis": ["name", "description", "sql_query", "category", "potential_value"],
    "insights": ["finding", "supporting_evidence", "impact", "confidence"],
    "opportunities": ["area", "description", "potential_value", "effort", "suggested_approach"],
    "art_of_the_possible": [
        "title", "description", "technologies_needed", "complexity", "business_value",
    ],
}


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _given(prefix: str, c: str) -> Column:
    """``prefix`` and value when there is one, else nothing."""
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", _t(prefix, F.col(c))).otherwise(F.lit(""))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def schema_context(
    tables: DataFrame,
    columns: DataFrame,
    relationships: DataFrame,
    entity_relationships: DataFrame,
    processes: DataFrame,
    use_cases: DataFrame,
    sample_queries: DataFrame,
) -> DataFrame:
    """Context text by section, each whole under its head; empty sections have no row.

    Sections are separated by an empty line, items by a line end.  ``processes``: the
    texts of ``assemble.process_texts``.
    """
    key = F.when(F.col("is_primary_key"), F.lit("  PK")).otherwise(F.lit(""))
    semantic = F.when(_text("semantic_type") != "", _t("  [", F.col("semantic_type"), "]")).otherwise(F.lit(""))
    entry = _t("  - ", F.col("column_name"), " (", F.col("data_type"), ")", semantic, _given("  ", "description"), key)
    listed = whole_text(columns, TABLE_KEY, "position", entry)
    block = _t(
        "Table: ", F.col("table_name"),
        _given("\n  Description: ", "description"),
        _given("\n  Role: ", "business_role"),
        _given("\n  Domain: ", "domain"),
        F.coalesce(_t("\n", F.col("text")), F.lit("")),
        "\n",
    )
    ends = [_t(F.col(f"{s}_table"), ".", F.col(f"{s}_column")) for s in ("from", "to")]
    sections = [
        (tables.join(listed, TABLE_KEY, "left"), "table_ordinal", "", block),
        (relationships, "rel_ordinal", "### Foreign Key Relationships\n", _t("  ", ends[0], "  ->  ", ends[1])),
        (
            entity_relationships, "ordinal", "### Entity Relationships\n",
            _t("  ", _text("entity"), "  ->  ", _text("related_entities"), _given("  :  ", "business_meaning")),
        ),
        (processes, "ordinal", "### Business Processes\n", _t("  ", _text("domain"), ":  ", _text("tables"))),
        (
            use_cases, "ordinal", "### Use Cases\n",
            _t("  ", _text("name"), ":  ", _text("description"), "\n    Tables: ", _text("involved_tables")),
        ),
        (
            sample_queries, "ordinal", "### Sample Queries\n",
            _t("  Question: ", _text("question"), "\n  SQL: ", _text("sql")),
        ),
    ]
    out = None
    for number, (df, ordinal, head, line) in enumerate(sections, 1):
        rows = whole_text(df, ["database_id"], ordinal, line).select(
            "database_id",
            F.lit(number).alias("section_no"),
            F.lit(0).cast("bigint").alias("part_no"),
            _t(head, F.col("text")).alias("text"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def domain_scope(requests: DataFrame, tables: DataFrame, entity_relationships: DataFrame) -> DataFrame:
    """Focus text of each request (request_id, database_id, domain, entity)."""
    key = ["request_id", "database_id"]
    names = tables.filter(F.coalesce("table_name", F.lit("")) != "").select(
        "database_id", "table_name", "table_ordinal", F.lower("domain").alias("low"), "domain"
    )
    everything = whole_text(names, ["database_id"], "table_ordinal", F.col("table_name"), ", ")
    everything = everything.withColumnRenamed("text", "all_tables")
    by_domain = whole_text(
        names.filter("low is not null"), ["database_id", "low"], "table_ordinal", F.col("table_name"), ", "
    ).withColumnRenamed("text", "domain_tables")
    domains = (
        names.filter(filled(F.col("domain")))
        .groupBy("database_id", "domain")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("database_id")
        .agg(joined_lines(["domain"], F.col("domain"), ", ").alias("domains"))
    )
    asked = requests.select(
        *key, F.nullif("domain", F.lit("")).alias("domain"), F.nullif("entity", F.lit("")).alias("entity")
    )
    notes = (
        asked.filter("entity is not null")
        .select(*key, "entity", F.lower("entity").alias("low"))
        .join(
            entity_relationships.select(
                "database_id", "ordinal", F.lower("entity").alias("low"), "related_entities", "business_meaning"
            ),
            ["database_id", "low"],
        )
        .groupBy(*key)
        .agg(
            joined_lines(
                ["ordinal"],
                _t("The '", F.col("entity"), "' entity is related to: ", _text("related_entities"),
                   " (", _text("business_meaning"), ")."),
                " ",
            ).alias("notes")
        )
    )
    d = F.col("domain")
    focus = F.when(
        d.isNotNull(),
        F.concat_ws(
            " ",
            _t("DOMAIN FILTER: Focus on the '", d, "' domain."),
            F.when(
                F.col("domain_tables").isNotNull(),
                _t("Relevant tables for this domain: ", F.col("domain_tables"), "."),
            ).otherwise(
                _t("No tables are explicitly tagged with the '", d,
                   "' domain. Choose the most relevant tables from: ", _text("all_tables"), ".")
            ),
        ),
    ).otherwise(
        F.concat_ws(
            " ",
            _t("DOMAIN OVERVIEW — The schema contains these actual domains: ", F.col("domains"), "."),
            _t("All tables in the schema: ", F.col("all_tables"),
               ". Generate insights that span these tables and domains — "
               "do NOT introduce domains or tables that are not listed above."),
        )
    )
    about = F.concat_ws(
        " ", _t("ENTITY FOCUS: Prioritize insights related to '", F.col("entity"), "'."), "notes"
    )
    text = F.concat_ws(" ", F.nullif(focus, F.lit("")), F.nullif(about, F.lit("")))
    return (
        asked.withColumn("low", F.lower("domain"))
        .join(by_domain, ["database_id", "low"], "left")
        # the whole listing goes to requests that use it only
        .withColumn("listed", F.when(F.col("domain_tables").isNull(), F.col("database_id")))
        .join(everything.withColumnRenamed("database_id", "listed"), "listed", "left")
        .withColumn("listed", F.when(d.isNull(), F.col("database_id")))
        .join(domains.withColumnRenamed("database_id", "listed"), "listed", "left")
        .join(notes, key, "left")
        .select(
            *key,
            F.when(
                text == "",
                F.lit("No domain or entity filter — cover all aspects of the business domain "
                      "reflected in the schema context."),
            )
            .otherwise(text)
            .alias("text"),
        )
    )


# ---------------------------------------------------------------- payloads


def payload_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of nested payloads: category → section → list.

    A payload that is itself one category (it has kpis) counts as "Overview".
    """
    body = F.try_parse_json(payload)
    as_map = F.try_variant_get(body, "$", "map<string,variant>")
    flat = F.try_variant_get(body, "$.kpis", "array<variant>").isNotNull()
    by_category = F.when(flat, F.create_map(F.lit(CATEGORIES[0]), body)).otherwise(as_map)
    rows = payloads.select("connection_id", F.explode(by_category).alias("category", "body"))
    out = None
    for section in SECTIONS:
        part = rows.select(
            "connection_id",
            "category",
            F.lit(section).alias("section"),
            F.posexplode(F.try_variant_get("body", f"$.{section}", "array<variant>")).alias("ordinal", "item"),
        )
        out = part if out is None else out.unionAll(part)
    return out.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def section_rows(items: DataFrame, section: str) -> DataFrame:
    """Typed rows of one section; missing texts are empty, missing numbers 0."""
    fields = []
    for name in SECTIONS[section]:
        if name == "confidence":
            value = F.coalesce(F.try_variant_get("item", "$.confidence", "double"), F.lit(0.0))
        else:
            value = F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))
        fields.append(value.alias(name))
    return items.filter(F.col("section") == section).select(
        "connection_id", F.col("category").alias("category_name"), "ordinal", *fields
    )


def category_runs(connections: DataFrame, results: DataFrame) -> DataFrame:
    """Items per category of every connection; failed or absent categories have none.

    ``results``: connection_id, category, section rows of successful runs.
    """
    wanted = connections.select(
        "connection_id",
        F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"),
    ).withColumn("domain", F.when(F.col("category") != CATEGORIES[0], F.col("category")))
    sizes = results.groupBy("connection_id", "category").agg(
        *[F.count_if(F.col("section") == s).alias(s) for s in SECTIONS]
    )
    return wanted.join(sizes, ["connection_id", "category"], "left").select(
        "connection_id", "category", "domain", *[F.coalesce(s, F.lit(0)).alias(s) for s in SECTIONS]
    )
