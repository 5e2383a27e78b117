"""Canonical relations, labels, assembly, validation and quality (B-G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.operators import assemble, canonical, enrich, labels, quality, validate
from skemata.plans import tenants as T
from skemata.plans.registry import query, read
from skemata.schemas import Catalog, Labels

# ---------------------------------------------------------------- B: canonical


@query
def canonical_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of all raw documents with nullability and key flags."""
    return canonical.canonicalise(T.raw_documents(spark, sf)).columns


@query
def canonical_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign keys with their constraint names, in document order."""
    return canonical.canonicalise(T.raw_documents(spark, sf)).relationships.drop("rel_ordinal")


@query
def canonical_tables(spark: SparkSession, sf: str) -> DataFrame:
    """B1: tables in document order."""
    return canonical.canonicalise(T.raw_documents(spark, sf)).tables


@query
def canonical_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views and their columns, with defaults filled in."""
    cat = canonical.canonicalise(T.raw_documents(spark, sf))
    return cat.views.join(cat.view_columns, ["database_id", "view_name"]).drop(
        "view_column_ordinal"
    )


@query
def database_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Database info with the version fallback."""
    return canonical.database_info(T.raw_documents(spark, sf))


@query
def relationship_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Both spellings of relationship ends, in both modes."""
    rels = T.catalog(spark, sf).relationships
    old = F.col("database_id") % 2 == 0
    empty = F.col("database_id") % 4 == 1
    mixed = rels.select(
        "database_id",
        "rel_ordinal",
        *[
            F.when(old, F.lit(None)).when(empty, F.lit("")).otherwise(F.col(new)).alias(new)
            for new, _ in canonical.ENDS
        ],
        *[F.when(old | empty, F.col(new)).alias(former) for new, former in canonical.ENDS],
    )
    truthy = canonical.normalise_relationship_keys(mixed, "truthy")
    present = canonical.normalise_relationship_keys(mixed, "present")
    return truthy.withColumn("mode", F.lit("truthy")).unionByName(
        present.withColumn("mode", F.lit("present"))
    )


@query
def arrow_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships written as text with an arrow."""
    rels = T.catalog(spark, sf).relationships
    text = F.when(
        F.col("rel_ordinal") % 3 != 0,
        F.concat("from_table", F.lit("."), "from_column", F.lit(" → "), "to_table", F.lit("."), "to_column"),
    ).otherwise(F.lit("no arrow here"))
    return canonical.parse_arrow_relationships(
        rels.select("database_id", "rel_ordinal", text.alias("description"))
    )


@query
def document_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Raw or enriched, decided per document."""
    docs = T.raw_documents(spark, sf)
    metadata = F.when(F.col("database_id") % 3 == 0, F.lit("{}"))
    return docs.select(
        "database_id",
        F.coalesce(
            canonical.is_enriched(metadata, F.col("tables"), F.col("database_type")), F.lit(False)
        ).alias("enriched"),
    )


@query
def schema_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Key flags from constraints, and from relationships for enriched columns."""
    cat = T.catalog(spark, sf)
    columns = cat.columns.select("database_id", "table_name", "column_name", "is_primary_key")
    raw = canonical.flagged_columns(columns, cat.constraints)
    enriched = canonical.flagged_from_relationships(columns, cat.relationships)
    return raw.withColumn("source", F.lit("raw")).unionByName(
        enriched.withColumn("source", F.lit("enriched"))
    )


@query
def rebuilt_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Constraints remade from flags, and relationship names with their fallback."""
    cat = T.catalog(spark, sf)
    flagged = canonical.flagged_from_relationships(cat.columns, cat.relationships)
    named = canonical.relationship_display_names(cat.relationships).select(
        "database_id",
        F.col("from_table").alias("table_name"),
        F.col("from_column").alias("column_name"),
        F.col("name").alias("constraint_name"),
        F.lit("RELATIONSHIP").alias("constraint_type"),
    )
    return canonical.rebuilt_constraints(flagged).unionByName(named)


@query
def inbound_references(spark: SparkSession, sf: str) -> DataFrame:
    """Who refers to each table."""
    return canonical.inbound_references(T.catalog(spark, sf).relationships)


# ------------------------------------------------------------------- C: rules


@query
def rule_classify_columns(spark: SparkSession, sf: str) -> DataFrame:
    """First matching rule per column."""
    columns = T.catalog(spark, sf).columns
    return labels.classify_columns(columns.select("database_id", "table_name", "column_name"))


@query
def semantic_classify_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Semantic rules only."""
    columns = T.catalog(spark, sf).columns
    return labels.classify_columns_semantic(
        columns.select("database_id", "table_name", "column_name")
    )


@query
def merged_semantic_types(spark: SparkSession, sf: str) -> DataFrame:
    """C4: rule labels before model labels."""
    rules = labels.classify_columns(T.catalog(spark, sf).columns)
    return labels.merge_semantic_types(rules, T.model_types(spark, sf))


@query
def schema_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns with their evidence."""
    return assemble.pattern_section(labels.schema_patterns(T.catalog(spark, sf).columns))


# ------------------------------------------------------------------- D: batches


@query
def table_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Listing text of every database."""
    cat = T.catalog(spark, sf)
    return labels.table_listing(cat.databases, cat.tables, cat.columns)


@query
def column_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt text of every batch of 10 tables."""
    cat = T.catalog(spark, sf)
    return labels.column_batch_text(cat.tables, cat.columns)


@query
def relationship_listing(spark: SparkSession, sf: str) -> DataFrame:
    """D3: foreign keys as text, with the database context line."""
    cat = T.catalog(spark, sf)
    return labels.relationship_listing(cat.databases, cat.relationships).join(
        labels.database_context(cat.databases), "database_id"
    )


@query
def answer_json(spark: SparkSession, sf: str) -> DataFrame:
    """Which answers hold JSON that parses."""
    answers = T.answers(spark, sf)
    parsed = labels.parsed_answers(answers)
    return answers.select("database_id", "pass_no", "batch_no").join(
        parsed.select("database_id", "pass_no", "batch_no", F.lit(True).alias("ok")),
        ["database_id", "pass_no", "batch_no"],
        "left",
    ).select("database_id", "pass_no", "batch_no", F.coalesce("ok", F.lit(False)).alias("parsed"))


@query
def answer_table_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Table labels from answers; a failed answer labels nothing."""
    return labels.table_labels(
        T.catalog(spark, sf).tables, labels.parsed_answers(T.answers(spark, sf))
    )


@query
def answer_column_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Column labels over all batches."""
    return labels.column_labels(labels.parsed_answers(T.answers(spark, sf)))


@query
def answer_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct entities in first-seen order."""
    return labels.entities(labels.parsed_answers(T.answers(spark, sf)))


@query
def answer_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Entity relationships, use cases and sample queries, normalised."""
    parsed = labels.parsed_answers(T.answers(spark, sf))

    def shaped(df: DataFrame, section: str, *fields: str) -> DataFrame:
        return df.select(
            "database_id",
            F.lit(section).alias("section"),
            "ordinal",
            F.concat_ws("|", *fields).alias("item"),
        )

    return (
        shaped(labels.entity_relationships(parsed), "entity_relationships",
               "entity", "related_entities", "business_meaning")
        .unionAll(shaped(labels.use_cases(parsed), "use_cases",
                         "name", "description", "involved_tables"))
        .unionAll(shaped(labels.sample_queries(parsed), "sample_queries",
                         "question", "sql", "category"))
    )


@query
def physical_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of the foreign keys."""
    return labels.physical_relationships(T.catalog(spark, sf).relationships)


@query
def section_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of databases without a schema are empty, not missing."""
    lab = T.labels(spark, sf)
    return labels.section_sizes(
        T.catalog(spark, sf).databases,
        {
            "entities": lab.entities,
            "entity_relationships": lab.entity_relationships,
            "use_cases": lab.use_cases,
            "sample_queries": lab.sample_queries,
        },
    )


# ------------------------------------------------------------------ E: assembly


def enriched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return enriched_of(T.catalog(spark, sf), T.labels(spark, sf))


def enriched_of(cat: Catalog, lab: Labels) -> tuple[DataFrame, DataFrame]:
    return (
        assemble.enrich_tables(cat.tables, lab.table_labels),
        assemble.enrich_columns(cat.columns, lab.column_labels),
    )


def named_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.name_relationships(
        T.catalog(spark, sf).relationships, T.labels(spark, sf).entity_relationships
    )


@query
def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tables, columns, views and relationships per database."""
    return assemble.catalog_counts(T.catalog(spark, sf))


@query
def enriched_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with their labels."""
    return enriched(spark, sf)[0].drop("table_type")


@query
def enriched_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns with their labels."""
    return enriched(spark, sf)[1]


@query
def view_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of views."""
    return assemble.view_sections(T.catalog(spark, sf).view_columns)


@query
def relationship_names(spark: SparkSession, sf: str) -> DataFrame:
    """Verb phrase and sentence of every foreign key."""
    return named_relationships(spark, sf).drop("rel_ordinal", "constraint_name")


@query
def business_processes(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of each domain, one row each."""
    return assemble.business_processes(enriched(spark, sf)[0])


@query
def issue_section(spark: SparkSession, sf: str) -> DataFrame:
    """Issues with empty texts instead of nulls, counted by kind."""
    issues = validate.validation_issues(T.catalog(spark, sf), T.labels(spark, sf))
    return (
        assemble.issue_section(issues)
        .groupBy("database_id", "severity", "type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("column") == "").alias("without_column"),
        )
    )


@query
def score_display(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as shown to people, truncated."""
    scores = quality_scores(spark, sf)
    return scores.select(
        "database_id",
        *[
            assemble.display_score(F.col(c)).alias(c)
            for c in ("overall_score", *quality.DIMENSIONS)
        ],
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched documents of all tenants, from their raw documents."""
    return enrich.enrich_raw(T.raw_documents(spark, sf), T.labels(spark, sf))


def _digest(section: str, *fields) -> Column:
    """MD5 over the items of a section, field by field."""
    def text(item):
        parts = [f(item) if callable(f) else item[f] for f in fields]
        return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])

    return F.md5(F.array_join(F.transform(section, text), ";"))


def _column_list(item) -> Column:
    return F.array_join(
        F.transform(
            item["columns"],
            lambda c: F.concat_ws(":", c["column_name"], c["data_type"], c["is_nullable"].cast("string")),
        ),
        ",",
    )


@query
def assembled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents, looked at section by section."""
    docs = documents(spark, sf)
    return docs.select(
        "database_id",
        F.col("metadata.database_name").alias("database_name"),
        F.col("metadata.columns_count").alias("columns_count"),
        _digest("tables", "table_name", "description", "business_role", "domain", _column_list).alias("tables"),
        _digest("views", "view_name", "definition", _column_list).alias("views"),
        _digest("relationships", "from_table", "from_column", "to_table", "to_column").alias("relationships"),
        _digest("entities", "name").alias("entities"),
        _digest("entity_relationships", "entity", "related_entities", "business_meaning").alias("pairs"),
        _digest("use_cases", "name", "description", "involved_tables").alias("use_cases"),
        _digest("sample_queries", "question", "sql", "category").alias("sample_queries"),
        F.size("business_processes").alias("n_processes"),
        F.size("validation_report").alias("n_issues"),
    )


# ---------------------------------------------------------------- F: validation


@query
def validation_issues(spark: SparkSession, sf: str) -> DataFrame:
    """All checks."""
    issues = validate.validation_issues(T.catalog(spark, sf), T.labels(spark, sf))
    return issues.drop(*validate.ORDER_COLUMNS)


@query
def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    """F8: WARN or PASS per database."""
    cat = T.catalog(spark, sf)
    return validate.validation_status(
        cat.databases, validate.validation_issues(cat, T.labels(spark, sf))
    )


STAR = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "supplier", "s_suppkey"),
    ("conversations", "conv_id", "benchmark", "item_id"),
]


@query
def orphan_fk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """child rows whose parent is missing, per foreign key."""
    out = None
    for child, key, parent, parent_key in STAR:
        one = validate.orphan_summary(
            f"{child}.{key}", read(spark, sf, child), [key], read(spark, sf, parent), [parent_key]
        )
        out = one if out is None else out.unionAll(one)
    return out


@query
def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """declared keys that are null or repeated."""
    keys = [
        ("lineitem", ["l_orderkey", "l_linenumber"]),
        ("labels", ["doc_id"]),
        ("orders", ["o_orderkey"]),
        ("events", ["user_id"]),
    ]
    out = None
    for name, cols in keys:
        one = validate.key_violations(read(spark, sf, name), cols).select(
            F.lit(name).alias("table_name"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"),
            "rows_count",
            "has_null",
        )
        out = one if out is None else out.unionAll(one)
    return out


# ------------------------------------------------------------------- G: quality


def _quality_inputs(spark: SparkSession, sf: str):
    tables, columns = enriched(spark, sf)
    return (
        T.catalog(spark, sf).databases,
        tables,
        columns,
        named_relationships(spark, sf),
        T.labels(spark, sf).entity_relationships,
    )


@query
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Five scores and the total per database."""
    return quality.quality_scores(
        *_quality_inputs(spark, sf), bare_columns=T.catalog(spark, sf).columns
    )


@query
def quality_scores_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with boilerplate verdicts, and names taken from the constraints."""
    dbs, tables, columns, rels, pairs = _quality_inputs(spark, sf)
    return quality.quality_scores(
        dbs, tables, columns, rels, pairs,
        verdicts=T.verdicts(tables, columns), name_col="constraint_name",
    )


@query
def quality_of_domain(spark: SparkSession, sf: str) -> DataFrame:
    """G1: scores of the tables of one domain; foreign keys are not narrowed."""
    dbs, tables, columns, rels, pairs = _quality_inputs(spark, sf)
    tables, columns = quality.scope(tables, columns, domain="Reference Data")
    return quality.quality_scores(dbs, tables, columns, rels, pairs)


@query
def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of all dimensions."""
    dbs, tables, columns, rels, _ = _quality_inputs(spark, sf)
    return quality.quality_issues(
        dbs, tables, columns, rels, verdicts=T.verdicts(tables, columns), name_col="constraint_name"
    ).drop("group_no", "place", "nth")


@query
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Advice for low scores."""
    return quality.recommendations(quality_scores(spark, sf))


@query
def issue_samples(spark: SparkSession, sf: str) -> DataFrame:
    """First five issues per database."""
    dbs, tables, columns, rels, _ = _quality_inputs(spark, sf)
    return quality.issue_sample(
        quality.quality_issues(dbs, tables, columns, rels, name_col="constraint_name")
    )
