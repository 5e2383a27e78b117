"""Objects, vectors, graph and question context (H-J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.functions.vectors import hash_embedding, norm
from skemata.operators import context, embed, graph, search, vector_index
from skemata.plans import tenants as T
from skemata.plans.catalog_queries import enriched, enriched_of
from skemata.plans.registry import query, read
from skemata.schemas import Catalog, Labels
from skemata.session import work_folder

# ------------------------------------------------------------------ H: objects


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return _objects_of(T.catalog(spark, sf), T.labels(spark, sf))


def _objects_of(cat: Catalog, lab: Labels) -> DataFrame:
    tables, columns = enriched_of(cat, lab)
    return embed.schema_objects(tables, columns, cat.relationships, lab.entity_relationships)


@query
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H5: text and key of every schema object."""
    return objects(spark, sf).drop("metadata")


@query
def object_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """H5: metadata of the objects, some fields of it."""
    m = lambda name: F.try_element_at("metadata", F.lit(name)).alias(name)
    return objects(spark, sf).select(
        "database_id", "object_key",
        *[m(n) for n in ("table_name", "column_name", "column_count", "is_primary_key",
                         "from_table", "relationship_type", "entity")],
    )


@query
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """H6: hash vectors of whole documents."""
    v = F.col("v")
    docs = read(spark, sf, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return docs.select(
        "doc_id",
        F.size(v).alias("dimensions"),
        F.round(norm(v), 6).alias("length"),
        *[F.round(F.get(v, F.lit(i)), 6).alias(f"v{i}") for i in (0, 1, 15, 16, 383)],
    )


@query
def model_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """H7: vectors from a user's encoder, here one that measures the text."""
    def encode(texts):
        return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]

    docs = read(spark, sf, "documents")
    out = embed.embed(docs, embed.model_vector(encode)(F.col("text")))
    v = F.col("embedding")
    return out.select("doc_id", *[F.get(v, F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)])


@query
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """H8: keyed upsert; base is the older half of the events by type, batch the rest."""
    events = read(spark, sf, "events")
    rows = events.select("user_id", "event_type", "value", "event_id", F.col("ts").alias("created_at"),
                         F.col("ts").alias("updated_at"))
    is_base = F.col("event_type").isin("view", "signup")
    base = embed.latest_by_key(rows.filter(is_base), ["user_id"], ["event_id"])
    batch = rows.filter(~is_base)
    return embed.upsert(
        base.select(*rows.columns), batch, ["user_id"], ["event_id"],
        F.to_timestamp(F.lit("2030-01-01 00:00:00")),
    )


# ------------------------------------------------------------------- H: search


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf, "embeddings")
    return (
        v.select(F.col("vec_id").alias("question_id"), "embedding"),
        v.select(F.col("vec_id").alias("object_key"), "label", "embedding"),
    )


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 6))


@query
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of every vector."""
    asked, stored = _vectors(spark, sf)
    return _rounded(search.nearest(asked, stored, 10))


@query
def knn_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors per label, with a different k for some labels."""
    asked, stored = _vectors(spark, sf)
    limits = {0: 3, 1: 6, 2: 3}
    return _rounded(search.top_per_type(asked, stored, limits, within=(), kind="label", others=2))


@query
def knn_sharded(spark: SparkSession, sf: str) -> DataFrame:
    """Many shards of vectors, met by blocks of questions."""
    asked, stored = _vectors(spark, sf)
    return _rounded(search.nearest(asked, stored, 5, shard_rows=200))


@query
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search and its recall against the exact one."""
    asked, stored = _vectors(spark, sf)
    exact = search.nearest(asked, stored, 10)
    near = search.nearest_approximate(asked, stored, 10, dimensions=64)
    return search.recall(exact, near, "question_id", "object_key")


@query
def trained_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The trained index, and whether it finds 0.9 of the exact neighbours."""
    asked, stored = _vectors(spark, sf)
    index = vector_index.build_index(stored, work_folder(spark, "vector-index"))
    near = vector_index.search_index(index, asked, stored, 10)
    found = search.recall(search.nearest(asked, stored, 10), near, "question_id", "object_key")
    return found.select("exact_pairs", (F.col("recall") >= 0.9).alias("reached"))


# -------------------------------------------------------------------- I: graph


@query
def graph_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Table, column and entity vertices."""
    tables, columns = enriched(spark, sf)
    t = graph.table_vertices(tables).select(
        "database_id", F.lit("Table").alias("kind"), F.col("table_name").alias("name"), "description"
    )
    c = graph.column_vertices(columns).select(
        "database_id", F.lit("Column"), F.concat("table_name", F.lit("."), "column_name"), "description"
    )
    e = graph.entity_vertices(T.labels(spark, sf).entities).select(
        "database_id", F.lit("Entity"), "name", F.lit(None).cast("string")
    )
    return t.unionAll(c).unionAll(e)


def fk_edges(spark: SparkSession, sf: str) -> DataFrame:
    cat = T.catalog(spark, sf)
    return graph.foreign_key_edges(cat.relationships, cat.columns)


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All four kinds of edges."""
    cat, lab = T.catalog(spark, sf), T.labels(spark, sf)

    def shaped(df: DataFrame, kind: str, start, end) -> DataFrame:
        return df.select("database_id", F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))

    c, dot = F.col, lambda a, b: F.concat(a, F.lit("."), b)
    return (
        shaped(graph.has_column_edges(cat.tables, cat.columns), "HAS_COLUMN", c("table_name"), c("column_name"))
        .unionAll(shaped(graph.foreign_key_edges(cat.relationships, cat.columns), "FK_TO",
                         dot("from_table", "from_column"), dot("to_table", "to_column")))
        .unionAll(shaped(graph.belongs_to_entity_edges(cat.tables, lab.entities), "BELONGS_TO_ENTITY",
                         c("table_name"), c("entity")))
        .unionAll(shaped(graph.related_to_edges(lab.entity_relationships, lab.entities), "RELATED_TO",
                         c("entity"), c("related")))
    )


@query
def split_entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Entity edges with comma lists split."""
    lab = T.labels(spark, sf)
    return graph.related_to_edges(lab.entity_relationships, lab.entities, split_related=True)


@query
def key_clashes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a uniqueness constraint would reject."""
    cat = T.catalog(spark, sf)
    names = cat.columns.select("database_id", F.lower("column_name").alias("column_name"))
    return graph.key_clashes(cat.tables, "Table", ["database_id", "table_name"]).unionAll(
        graph.key_clashes(names, "Column", ["database_id", "column_name"])
    )


@query
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """I8: foreign keys usable both ways."""
    return graph.adjacency(fk_edges(spark, sf))


STARTS = ["region", "part", "lineitem", "customer"]


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("database_id")
    return T.customers(spark, sf).select(
        "database_id", F.array(*[T.table_name(k, F.lit(s)) for s in STARTS]).alias("start_tables")
    )


@query
def join_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Simple paths of at most 3 hops between four tables of every tenant."""
    return _path_texts(graph.join_paths(fk_edges(spark, sf), _starts(spark, sf), 3))


@query
def join_paths_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The same paths, grown from both ends."""
    return _path_texts(graph.join_paths_both_ends(fk_edges(spark, sf), _starts(spark, sf), 3))


def _path_texts(paths: DataFrame) -> DataFrame:
    step = lambda s: F.concat(s["from_table"], F.lit("."), s["from_column"], F.lit("="),
                              s["to_table"], F.lit("."), s["to_column"])
    return paths.select(
        "database_id", "i", "j", F.array_join("tables", ">").alias("tables"),
        F.array_join(F.transform("path", step), ";").alias("steps"), "hops",
    )


@query
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Tables around the orders table, and the keys among them."""
    cat, k = T.catalog(spark, sf), F.col("database_id")
    chosen = T.customers(spark, sf).select(
        "database_id", T.table_name(k, F.lit("orders")).alias("selected_table")
    )
    near = graph.neighbourhood(cat.relationships, chosen)
    edges = graph.neighbourhood_edges(cat.relationships, near)
    return near.select("database_id", F.lit("node").alias("kind"), F.col("table_name").alias("name")).unionAll(
        edges.select("database_id", F.lit("edge"), F.concat_ws("-", *graph.ENDS))
    )


@query
def path_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring tables of all paths."""
    paths = graph.join_paths(fk_edges(spark, sf), _starts(spark, sf), 2)
    return graph.path_pairs(paths, ["database_id"]).drop("first_seen")


@query
def diagram(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges of the diagram."""
    cat = T.catalog(spark, sf)
    return graph.diagram_edges(cat.relationships).unionByName(
        graph.diagram_nodes(cat.tables).select("database_id", F.col("node_id").alias("edge_id")),
        allowMissingColumns=True,
    )


# ------------------------------------------------------------------ J: context


def question_id() -> Column:
    """A turn's id: the conversation in the upper half, the turn in the lower."""
    return (F.shiftleft("conv_id", 32) + F.col("turn")).alias("question_id")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns of the conversations, each asked of the tenant with its number."""
    talk = read(spark, sf, "conversations").filter(F.col("role") == "user")
    return talk.select(
        question_id(),
        F.col("conv_id").alias("database_id"),
        hash_embedding(F.col("text")).alias("embedding"),
    )


def asked_about(spark: SparkSession, sf: str) -> tuple[T.TenantCatalog, T.TenantLabels]:
    """Catalog and labels of the databases that are asked about; rows of others meet nothing."""
    asked = questions(spark, sf).select("database_id")
    return T.catalog(spark, sf, asked), T.labels(spark, sf, asked)


def vectors(cat: Catalog, lab: Labels) -> DataFrame:
    """Embedded objects of these databases."""
    return embed.embed(_objects_of(cat, lab))


HITS = {"table": 3, "column": 6, "relationship": 3}


def _context(spark: SparkSession, sf: str) -> context.SchemaContext:
    cat, lab = asked_about(spark, sf)
    tables, columns = enriched_of(cat, lab)
    return context.build_context(
        questions(spark, sf), vectors(cat, lab), tables, columns, cat.relationships,
        lab.entity_relationships, graph.foreign_key_edges(cat.relationships, cat.columns), HITS,
    )


@query
def question_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Best tables, columns and relationships per question."""
    hits = context.question_hits(questions(spark, sf), vectors(*asked_about(spark, sf)), HITS)
    return _rounded(hits.drop("metadata"))


@query
def question_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context of every question as tagged rows."""
    rows = context.context_rows(_context(spark, sf))
    return _rounded(rows)


@query
def context_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Full prompt text."""
    columns = enriched_of(*asked_about(spark, sf))[1]
    return context.full_prompt(questions(spark, sf), _context(spark, sf), columns)


@query
def compact_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Compact prompt text."""
    return context.compact_prompt(
        questions(spark, sf), _context(spark, sf), asked_about(spark, sf)[0].columns
    )


@query
def context_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and table names per question."""
    return context.context_summary(questions(spark, sf), _context(spark, sf))


@query
def topic_context(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval for a domain, an entity, both or neither."""
    talk = read(spark, sf, "conversations").filter(F.col("role") == "user")
    turn = F.col("turn") % 4
    asked = talk.select(
        question_id(),
        F.col("conv_id").alias("database_id"),
        F.when(turn < 2, F.lit("Reference Data")).alias("domain"),
        F.when(turn % 2 == 0, F.lit("Order")).alias("entity"),
    )
    cat, lab = asked_about(spark, sf)
    edges = graph.foreign_key_edges(cat.relationships, cat.columns)
    return context.topic_context(asked, vectors(cat, lab), edges)
