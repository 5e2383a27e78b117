"""Schema context for batches of questions: search hits, graph paths, prompt text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.text import strip, title
from skemata.functions.vectors import hash_embedding
from skemata.operators.graph import ENDS, join_paths, path_pairs
from skemata.operators.search import top_per_type
from skemata.scale import joined_lines, part_of, skew_join, whole_text
from skemata.session import cut_lineage

QUESTION = ["question_id", "database_id"]
TABLE_KEY = ["database_id", "table_name"]
COLUMN_KEY = ["database_id", "table_name", "column_name"]

# How many hits of each kind, and how far the graph is walked.
LIMITS = {"table": 10, "column": 20, "relationship": 10}
GRAPH_HOPS = 2


@dataclass(frozen=True)
class SchemaContext:
    """Five relations keyed by question; ``o1, o2, o3`` give the order of each."""

    tables: DataFrame
    columns: DataFrame
    relationships: DataFrame
    join_paths: DataFrame
    entity_relationships: DataFrame


def question_hits(
    questions: DataFrame, objects: DataFrame, limits: Mapping[str, int] = LIMITS
) -> DataFrame:
    """Ranked objects per question and type, with their metadata.

    ``questions``: question_id, database_id, embedding.
    """
    ranked = top_per_type(questions, objects, limits)
    return (
        ranked.join(questions.select(*QUESTION), "question_id")
        .join(
            objects.select("database_id", "object_key", "metadata"), ["database_id", "object_key"]
        )
        .select(*QUESTION, "object_type", "object_key", "similarity", "rank", "metadata")
    )


def _meta(name: str) -> Column:
    return F.try_element_at("metadata", F.lit(name))


def matched_tables(hits: DataFrame) -> DataFrame:
    return (
        hits.filter(F.col("object_type").isin("table", "column"))
        .select(*QUESTION, _meta("table_name").alias("table_name"))
        .distinct()
    )


def start_tables(matched: DataFrame) -> DataFrame:
    """Sorted start list per question; bounded by the hit limits."""
    return matched.groupBy(*QUESTION).agg(F.array_sort(F.collect_set("table_name")).alias("start_tables"))


def _or_meta(field: str) -> Column:
    """The catalog's value, even null, when the catalog has the row."""
    return F.when(F.col("__known"), F.col(field)).otherwise(F.coalesce(_meta(field), F.lit("")))


def table_context(hits: DataFrame, tables: DataFrame, paths: DataFrame) -> DataFrame:
    """Table hits in rank order, then tables only found on join paths."""
    fields = ["description", "business_role", "domain"]
    known = tables.select(*TABLE_KEY, *fields, F.lit(True).alias("__known"))
    first = (
        hits.filter(F.col("object_type") == "table")
        .groupBy(*QUESTION, _meta("table_name").alias("table_name"))
        .agg(F.min_by(F.struct("similarity", "metadata"), "rank").alias("h"), F.min("rank").alias("rank"))
        .select(*QUESTION, "table_name", "h.*", "rank")
    )
    on_paths = (
        paths.select(*QUESTION, "i", "j", "hops", "tables", F.posexplode("tables").alias("nth", "table_name"))
        .groupBy(*QUESTION, "table_name")
        .agg(F.min(F.struct("i", "j", "hops", "tables", "nth")).alias("seen"))
        .join(first.select("question_id", "table_name"), ["question_id", "table_name"], "left_anti")
    )
    rows = first.select(
        *QUESTION, "table_name", "similarity", "metadata",
        F.col("rank").cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.lit("").alias("o3"),
    ).unionByName(
        on_paths.select(
            *QUESTION, "table_name", F.lit(0.0).alias("similarity"),
            F.lit(None).cast("map<string,string>").alias("metadata"),
            F.lit(1 << 20).cast("bigint").alias("o1"),
            _pair_order("seen").alias("o2"),
            F.concat_ws("/", F.col("seen.hops").cast("string"), F.array_join("seen.tables", "/"),
                        F.lpad(F.col("seen.nth").cast("string"), 4, "0")).alias("o3"),
        )
    )
    return rows.join(known, TABLE_KEY, "left").withColumn(
        "__known", F.coalesce("__known", F.lit(False))
    ).select(
        *QUESTION, "table_name", *[_or_meta(f).alias(f) for f in fields], "similarity", "o1", "o2", "o3"
    )


def column_context(hits: DataFrame, columns: DataFrame) -> DataFrame:
    fields = ["data_type", "semantic_type", "description"]
    flags = ["is_primary_key", "is_nullable"]
    known = columns.select(*COLUMN_KEY, *fields, *flags, F.lit(True).alias("__known"))
    first = (
        hits.filter(F.col("object_type") == "column")
        .groupBy(*QUESTION, _meta("table_name").alias("table_name"), _meta("column_name").alias("column_name"))
        .agg(F.min_by(F.struct("similarity", "metadata"), "rank").alias("h"), F.min("rank").alias("rank"))
        .select(*QUESTION, "table_name", "column_name", "h.*", "rank")
    )

    def flag(name: str, default: bool) -> Column:
        given = F.coalesce(_meta(name).cast("boolean"), F.lit(default))
        return F.when(F.col("__known"), F.col(name)).otherwise(given).alias(name)

    return first.join(known, COLUMN_KEY, "left").withColumn(
        "__known", F.coalesce("__known", F.lit(False))
    ).select(
        *QUESTION, "table_name", "column_name", *[_or_meta(f).alias(f) for f in fields],
        flag("is_primary_key", False), flag("is_nullable", True), "similarity",
        F.col("rank").cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.lit("").alias("o3"),
    )


def relationship_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Foreign-key hits and entity hits, each deduplicated in rank order."""
    kind = F.coalesce(_meta("relationship_type"), F.lit("foreign_key"))
    rels = hits.filter(F.col("object_type") == "relationship")

    def pick(df: DataFrame, fields: dict[str, Column], keys: list[str]) -> DataFrame:
        return (
            df.select(*QUESTION, *[c.alias(n) for n, c in fields.items()], "similarity", "rank")
            .groupBy(*QUESTION, *keys)
            .agg(F.min_by(F.struct(*[n for n in fields if n not in keys], "similarity"), "rank").alias("h"),
                 F.min("rank").cast("bigint").alias("o1"))
            .select(*QUESTION, *keys, "h.*", "o1", F.lit(0).cast("bigint").alias("o2"), F.lit("").alias("o3"))
        )

    def end(new: str, old: str) -> Column:
        return F.coalesce(F.nullif(_meta(new), F.lit("")), _meta(old), F.lit(""))

    foreign = {
        "from_table": end("from_table", "child_table"),
        "from_column": end("from_column", "child_column"),
        "to_table": end("to_table", "parent_table"),
        "to_column": end("to_column", "parent_column"),
    }
    entity = {
        "entity": _meta("entity"),
        "related_entities": _meta("related_entities"),
        "business_meaning": F.coalesce(_meta("business_meaning"), F.lit("")),
    }
    return (
        pick(rels.filter(kind == "foreign_key"), foreign, ENDS),
        pick(rels.filter(kind != "foreign_key"), entity, ["entity", "related_entities"]),
    )


def relationship_context(foreign: DataFrame, seen: DataFrame, relationships: DataFrame) -> DataFrame:
    """Foreign-key hits, then every catalog key with either end in a seen table.

    Two equi-joins and a union instead of one join on a disjunction.
    """
    rels = relationships.select("database_id", *ENDS, "rel_ordinal")

    def touching(side: str) -> DataFrame:
        tables = seen.select(*QUESTION, F.col("table_name").alias(side))
        return skew_join(rels, tables, ["database_id", side], "inner", ["rel_ordinal"]).select(
            *QUESTION, *ENDS, "rel_ordinal"
        )

    extra = (
        touching("from_table")
        .unionByName(touching("to_table"))
        .groupBy(*QUESTION, *ENDS)
        .agg(F.min("rel_ordinal").alias("o2"))
        .join(foreign.select("question_id", *ENDS), ["question_id", *ENDS], "left_anti")
    )
    return foreign.select(*QUESTION, *ENDS, "similarity", "o1", "o2", "o3").unionByName(
        extra.select(
            *QUESTION, *ENDS, F.lit(0.0).alias("similarity"), F.lit(1 << 20).cast("bigint").alias("o1"),
            "o2", F.lit("").alias("o3"),
        )
    )


def entity_context(entity: DataFrame, seen: DataFrame, entity_relationships: DataFrame) -> DataFrame:
    """Entity hits, then relationships of an entity named like a seen table."""
    named = seen.select(*QUESTION, title(F.col("table_name")).alias("name")).distinct()
    pairs = entity_relationships.select(
        "database_id", "entity", "related_entities",
        F.coalesce("business_meaning", F.lit("")).alias("business_meaning"), "ordinal",
    )

    def about(side: str) -> DataFrame:
        return skew_join(
            pairs, named.withColumnRenamed("name", side), ["database_id", side], "inner", ["ordinal"]
        ).select(*QUESTION, "entity", "related_entities", "business_meaning", "ordinal")

    keys = ["entity", "related_entities"]
    extra = (
        about("entity")
        .unionByName(about("related_entities"))
        .groupBy(*QUESTION, *keys)
        .agg(F.min_by("business_meaning", "ordinal").alias("business_meaning"), F.min("ordinal").alias("o2"))
        .join(entity.select("question_id", *keys), ["question_id", *keys], "left_anti")
    )
    fields = [*QUESTION, *keys, "business_meaning", "similarity", "o1", "o2", "o3"]
    return entity.select(*fields).unionByName(
        extra.select(
            *QUESTION, *keys, "business_meaning", F.lit(0.0).alias("similarity"),
            F.lit(1 << 20).cast("bigint").alias("o1"), "o2", F.lit("").alias("o3"),
        )
    )


def _pair_order(pair: str) -> Column:
    """Order of a pair (i, j) of start tables as one number."""
    return F.shiftleft(F.col(f"{pair}.i").cast("bigint"), 31) + F.col(f"{pair}.j")


def path_context(paths: DataFrame, distinct_steps: bool = False) -> DataFrame:
    """One path per sequence of tables; parallel keys give the first of them."""
    steps = F.to_json("path")
    keys = [*QUESTION, "tables"] + (["steps"] if distinct_steps else [])
    return (
        paths.withColumn("steps", steps)
        .groupBy(*keys)
        .agg(F.min_by("path", F.struct("i", "j", "hops", "steps")).alias("path"),
             F.min(F.struct("i", "j")).alias("p"), F.min("hops").alias("hops"))
        .select(
            *QUESTION, "tables", "path", "hops",
            _pair_order("p").alias("o1"),
            F.col("hops").cast("bigint").alias("o2"),
            F.array_join("tables", "/").alias("o3"),
        )
    )


def build_context(
    questions: DataFrame,
    objects: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    relationships: DataFrame,
    entity_relationships: DataFrame,
    edges: DataFrame,
    limits: Mapping[str, int] = LIMITS,
    hops: int = GRAPH_HOPS,
) -> SchemaContext:
    hits = question_hits(questions, objects, limits)
    return context_from_hits(
        hits, tables, columns, relationships, entity_relationships, edges, hops
    )


def context_from_hits(
    hits: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    relationships: DataFrame,
    entity_relationships: DataFrame,
    edges: DataFrame,
    hops: int = GRAPH_HOPS,
) -> SchemaContext:
    # hits, paths and tables are read by several sections each, and are small
    # next to the vectors and catalogs they were found in
    hits = cut_lineage(hits)
    paths = cut_lineage(join_paths(edges, start_tables(matched_tables(hits)), hops))
    seen = cut_lineage(table_context(hits, tables, paths))
    foreign, entity = relationship_hits(hits)
    return SchemaContext(
        tables=seen,
        columns=column_context(hits, columns),
        relationships=relationship_context(foreign, seen, relationships),
        join_paths=path_context(paths),
        entity_relationships=entity_context(entity, seen, entity_relationships),
    )


# ------------------------------------------------------------------ prompt text


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _none(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("None"))


def _lines(df: DataFrame, section_no: int, line: Column) -> DataFrame:
    return df.select(
        "question_id", F.lit(section_no).alias("section_no"), part_of("o2").alias("chunk"),
        "o1", "o2", "o3", line.alias("line"),
    )


def _sections(lines: DataFrame, heads: Mapping[int, str], ends: Mapping[int, str], between: str) -> DataFrame:
    """Prompt per question: lines are joined per chunk, chunks per section, sections last."""
    chunks = lines.groupBy("question_id", "section_no", "o1", "chunk").agg(
        joined_lines(["o2", "o3"], F.col("line"), "\n").alias("text")
    )
    sections = chunks.groupBy("question_id", "section_no").agg(
        joined_lines(["o1", "chunk"], F.col("text"), "\n").alias("body")
    )

    def pick(texts: Mapping[int, str]) -> Column:
        chosen = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
        return F.try_element_at(chosen, F.col("section_no"))

    section = _t(pick(heads), F.col("body"), pick(ends))
    return sections.groupBy("question_id").agg(
        strip(joined_lines(["section_no"], section, between)).alias("prompt")
    )


def _column_blocks(wanted: DataFrame, columns: DataFrame, line: Column) -> DataFrame:
    """Column lines of the wanted tables only."""
    mine = columns.join(wanted.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_semi")
    return whole_text(mine, TABLE_KEY, "position", line)


def _path_lines(step_from: str = "    ") -> Column:
    steps = F.transform(
        F.col("path"),
        lambda s: _t(step_from, s["from_table"], ".", s["from_column"], "  →  ", s["to_table"], ".", s["to_column"]),
    )
    head = _t("  ", F.array_join("tables", " → "), "  (", F.col("hops").cast("string"), " hop(s))")
    return F.array_join(F.concat(F.array(head), steps), "\n")


def full_prompt(questions: DataFrame, context: SchemaContext, columns: DataFrame) -> DataFrame:
    """Five sections per question; a section without rows is left out, and a question
    without any has an empty text."""
    described = F.coalesce(F.col("description"), F.lit(""))
    flags = F.concat_ws(
        " ", F.when(F.col("is_primary_key"), F.lit("PK")), F.when(~F.col("is_nullable"), F.lit("NOT NULL"))
    )
    entry = _t(
        "    - ", F.col("column_name"), " (", F.col("data_type"), ")[", _none("semantic_type"), "]",
        F.when(described != "", _t(": ", described)).otherwise(F.lit("")),
        F.when(flags != "", _t("  ", flags)).otherwise(F.lit("")),
    )
    blocks = _column_blocks(context.tables, columns, entry)
    tables = context.tables.join(blocks, TABLE_KEY, "left")
    table_block = _t(
        "Table: ", F.col("table_name"),
        "\n  Description: ", _none("description"),
        "\n  Business Role: ", _none("business_role"),
        "\n  Domain: ", _none("domain"),
        "\n  Columns:",
        F.coalesce(_t("\n", F.col("text")), F.lit("")),
        "\n",
    )
    meaning = F.coalesce("business_meaning", F.lit(""))
    lines = [
        _lines(tables, 1, table_block),
        _lines(
            context.columns, 2,
            _t("  ", F.col("table_name"), ".", F.col("column_name"), "  (", F.col("data_type"), ")  [",
               _none("semantic_type"), "]  ", _none("description")),
        ),
        _lines(
            context.relationships, 3,
            _t("  ", F.col("from_table"), ".", F.col("from_column"), "  →  ", F.col("to_table"), ".", F.col("to_column")),
        ),
        _lines(context.join_paths, 4, _t(_path_lines(), "\n")),
        _lines(
            context.entity_relationships, 5,
            _t("  ", F.col("entity"), "  →  ", F.col("related_entities"),
               F.when(meaning != "", _t("  :  ", meaning)).otherwise(F.lit(""))),
        ),
    ]
    rows = lines[0]
    for more in lines[1:]:
        rows = rows.unionAll(more)
    heads = {
        1: "### Tables\n\n", 2: "### Relevant Columns\n\n", 3: "### Foreign Key Relationships\n\n",
        4: "### Join Paths\n\n", 5: "### Entity Relationships\n\n",
    }
    # every section ends with an empty line; blocks of sections 1 and 4 carry their own
    ends = {1: "", 2: "\n", 3: "\n", 4: "", 5: "\n"}
    text = _sections(rows, heads, ends, "\n")
    return questions.select("question_id").join(text, "question_id", "left").select(
        "question_id", F.coalesce("prompt", F.lit("")).alias("prompt")
    )


def compact_prompt(questions: DataFrame, context: SchemaContext, columns: DataFrame) -> DataFrame:
    """Names, types and keys only; "(no schema context)" when nothing was found."""
    entry = _t(
        "    - ", F.col("column_name"), " (", F.col("data_type"), ")",
        F.when(F.col("is_primary_key"), F.lit(" PK")).otherwise(F.lit("")),
    )
    blocks = _column_blocks(context.tables, columns, entry)
    tables = context.tables.join(blocks, TABLE_KEY, "left")
    lines = [
        _lines(tables, 1, _t("  Table: ", F.col("table_name"), F.coalesce(_t("\n", F.col("text")), F.lit("")))),
        _lines(
            context.relationships, 2,
            _t("  ", F.col("from_table"), ".", F.col("from_column"), "  →  ", F.col("to_table"), ".", F.col("to_column")),
        ),
        _lines(context.join_paths, 3, _path_lines()),
    ]
    rows = lines[0].unionAll(lines[1]).unionAll(lines[2])
    heads = {1: "### Tables\n", 2: "### Foreign Key Relationships\n", 3: "### Join Paths\n"}
    text = _sections(rows, heads, {1: "", 2: "", 3: ""}, "\n\n")
    return questions.select("question_id").join(text, "question_id", "left").select(
        "question_id", F.coalesce("prompt", F.lit("(no schema context)")).alias("prompt")
    )


def context_summary(questions: DataFrame, context: SchemaContext) -> DataFrame:
    """Five counts per question, and the table names in order."""
    counted = {
        "table_count": context.tables,
        "column_count": context.columns,
        "relationship_count": context.relationships,
        "join_path_count": context.join_paths,
        "entity_relationship_count": context.entity_relationships,
    }
    out = questions.select("question_id")
    for name, df in counted.items():
        out = out.join(df.groupBy("question_id").agg(F.count(F.lit(1)).alias(name)), "question_id", "left")
    names = context.tables.groupBy("question_id").agg(
        joined_lines(["o1", "o2", "o3"], F.col("table_name"), ", ").alias("table_names")
    )
    return out.join(names, "question_id", "left").select(
        "question_id",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in counted],
        F.coalesce("table_names", F.lit("")).alias("table_names"),
    )


def context_rows(context: SchemaContext) -> DataFrame:
    """One row per piece of context, tagged by type."""
    table = context.tables.select(
        "question_id", F.lit("table").alias("type"), F.col("table_name").alias("name"), "similarity"
    )
    column = context.columns.select(
        "question_id", F.lit("column").alias("type"), F.col("table_name").alias("table"),
        F.col("column_name").alias("name"), "similarity",
    )
    foreign = context.relationships.select(
        "question_id", F.lit("relationship").alias("type"),
        _t(F.col("from_table"), ".", F.col("from_column")).alias("from"),
        _t(F.col("to_table"), ".", F.col("to_column")).alias("to"), "similarity",
    )
    path = context.join_paths.select(
        "question_id", F.lit("join_path").alias("type"), F.array_join("tables", ",").alias("tables"),
        F.col("hops").cast("bigint").alias("hops"),
    )
    entity = context.entity_relationships.select(
        "question_id", F.lit("entity_relationship").alias("type"), "entity", "related_entities",
        "business_meaning",
    )
    out = table
    for more in (column, foreign, path, entity):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


# ---------------------------------------------------- retrieval for a domain

# How many objects of each type a topic asks for, unless told otherwise.
TOPIC_LIMITS = {"table": 10, "relationship": 5}


def topic_questions(requests: DataFrame) -> DataFrame:
    """Search text of a request: its domain and entity, else a general one."""
    domain, entity = F.nullif("domain", F.lit("")), F.nullif("entity", F.lit(""))
    text = F.concat_ws(
        " ", F.concat(F.lit("domain "), domain), F.concat(F.lit("entity "), entity)
    )
    text = F.when(text == "", F.lit("business schema")).otherwise(text)
    return requests.select(*QUESTION, text.alias("text"), hash_embedding(text).alias("embedding"))


def topic_context(
    requests: DataFrame,
    objects: DataFrame,
    edges: DataFrame,
    hops: int = 2,
    limits: Mapping[str, int] = TOPIC_LIMITS,
) -> DataFrame:
    """Text block per request: similar tables, entity relations, neighbours on join paths.
    ``limits``: how many objects of each type are looked for."""
    hits = cut_lineage(question_hits(topic_questions(requests), objects, limits))
    tables = hits.filter((F.col("object_type") == "table") & (_meta("table_name") != "")).select(
        *QUESTION, "rank", _meta("table_name").alias("table_name")
    )
    listed = tables.groupBy(*QUESTION).agg(
        _t("Tables retrieved by vector similarity: ", joined_lines(["rank"], F.col("table_name"), ", ")).alias("t1"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "table_name"))), lambda t: t["table_name"]
        ).alias("start_tables"),
    )
    found = hits.filter(
        (F.col("object_type") == "relationship") & (_meta("relationship_type") == "entity_relationship")
    ).select(
        *QUESTION, F.lit(0).alias("kind"),
        F.struct(
            F.col("rank").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("hops"),
            F.array().cast("array<string>").alias("tables"), F.lit(0).alias("nth"),
        ).alias("place"),
        _meta("entity").alias("entity"), _meta("related_entities").alias("related_entities"),
        F.coalesce(_meta("business_meaning"), F.lit("")).alias("meaning"),
    )
    pairs = path_pairs(join_paths(edges, listed.select(*QUESTION, "start_tables"), hops), QUESTION).select(
        *QUESTION, F.lit(1).alias("kind"), F.col("first_seen").alias("place"), "entity", "related_entities",
        F.lit("Discovered via FK join path").alias("meaning"),
    )
    line = _t(
        "  ", F.col("entity"), " -> ", F.col("related_entities"),
        F.when(F.col("meaning") != "", _t("  :  ", F.col("meaning"))).otherwise(F.lit("")),
    )
    related = found.unionByName(pairs).groupBy(*QUESTION).agg(
        _t("Entity relationships from retrieval:\n", joined_lines(["kind", "place"], line, "\n")).alias("t2")
    )
    return (
        requests.select(*QUESTION)
        .join(listed.drop("start_tables"), QUESTION, "left")
        .join(related, QUESTION, "left")
        .select(*QUESTION, F.concat_ws("\n\n", "t1", "t2").alias("text"))
    )

