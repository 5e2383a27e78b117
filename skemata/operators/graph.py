"""The catalog as a graph: vertices, edges, and paths between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.functions.text import strip
from skemata.scale import skew_join
from skemata.session import cut_lineage

TABLE_KEY = ["database_id", "table_name"]
COLUMN_KEY = ["database_id", "table_name", "column_name"]
ENDS = ["from_table", "from_column", "to_table", "to_column"]
STEP = (
    "struct<from_table:string,from_column:string,to_table:string,to_column:string>"
)


# -------------------------------------------------------------- vertices, edges


def _last_of(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*fields), order).alias("__last"))
        .select(*keys, "__last.*")
    )


def table_vertices(tables: DataFrame) -> DataFrame:
    """One vertex per table name; the last row sets the attributes."""
    return _last_of(tables, TABLE_KEY, ["description", "business_role", "domain"], "table_ordinal")


def column_vertices(columns: DataFrame) -> DataFrame:
    fields = ["data_type", "is_nullable", "is_primary_key", "description", "semantic_type"]
    return _last_of(columns, COLUMN_KEY, fields, "column_ordinal")


def has_column_edges(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Table to column.  A column of an unknown table has no edge."""
    known = tables.select(*TABLE_KEY).distinct()
    return columns.select(*COLUMN_KEY).distinct().join(known, TABLE_KEY, "left_semi")


def foreign_key_edges(relationships: DataFrame, columns: DataFrame) -> DataFrame:
    """Column to column, only where both columns exist; repeats are merged first."""
    edges = relationships.select("database_id", *ENDS).distinct()
    known = columns.select(*COLUMN_KEY)

    def exists(df: DataFrame, side: str) -> DataFrame:
        ends = [f"{side}_table", f"{side}_column"]
        there = known.select(
            "database_id",
            F.col("table_name").alias(ends[0]),
            F.col("column_name").alias(ends[1]),
        )
        return skew_join(df, there, ["database_id", *ends], "left_semi", ENDS)

    return exists(exists(edges, "from"), "to")


def entity_vertices(entities: DataFrame) -> DataFrame:
    return entities.select("database_id", "name").distinct()


def belongs_to_entity_edges(tables: DataFrame, entities: DataFrame) -> DataFrame:
    """Table to the entity of the same name in any case; the last such entity."""
    by_name = (
        entities.groupBy("database_id", F.lower("name").alias("__low"))
        .agg(F.max_by("name", "ordinal").alias("entity"))
    )
    return (
        tables.select(*TABLE_KEY, F.lower("table_name").alias("__low"))
        .distinct()
        .join(by_name, ["database_id", "__low"])
        .select(*TABLE_KEY, "entity")
    )


def related_to_edges(
    entity_relationships: DataFrame, entities: DataFrame, split_related: bool = False
) -> DataFrame:
    """Entity to entity, both names exact.

    A comma list is one name and matches nothing, unless ``split_related``.
    """
    pairs = entity_relationships.select(
        "database_id",
        "entity",
        F.col("related_entities").alias("related"),
        F.coalesce("business_meaning", F.lit("")).alias("business_meaning"),
    )
    if split_related:
        pairs = pairs.withColumn("related", F.explode(F.split("related", ","))).withColumn(
            "related", strip(F.col("related"))
        )
    known = entity_vertices(entities)
    pairs = pairs.distinct()
    for side in ("entity", "related"):
        pairs = pairs.join(
            known.withColumnRenamed("name", side), ["database_id", side], "left_semi"
        )
    return pairs.select("database_id", "entity", "related", "business_meaning")


def key_clashes(rows: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    """Keys that a uniqueness constraint would reject."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows_count"))
        .filter("rows_count > 1")
        .select(
            keys[0],
            F.lit(kind).alias("kind"),
            F.concat_ws(".", *[F.col(k) for k in keys[1:]]).alias("key"),
            "rows_count",
        )
    )


# ------------------------------------------------------------------------ paths


def adjacency(edges: DataFrame) -> DataFrame:
    """Each foreign key usable both ways, columns swapped."""
    edges = edges.select("database_id", *ENDS).distinct()
    back = edges.select(
        "database_id",
        *[F.col(a).alias(b) for a, b in zip(ENDS, [ENDS[2], ENDS[3], ENDS[0], ENDS[1]])],
    )
    return edges.unionByName(back)


def start_pairs(starts: DataFrame, tables: str = "start_tables") -> DataFrame:
    """Pairs i < j of each question's own list of start tables.

    The list is an array in the row, bounded by the search limits that filled
    it; the pairs are made in the row.
    """
    listed = F.transform(F.col(tables), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    pairs = F.flatten(
        F.transform(
            listed,
            lambda a: F.transform(
                F.filter(listed, lambda b: b["i"] > a["i"]),
                lambda b: F.struct(
                    a["i"].alias("i"), b["i"].alias("j"), a["t"].alias("src"), b["t"].alias("tgt")
                ),
            ),
        )
    )
    keys = [c for c in starts.columns if c != tables]
    return starts.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def join_paths(
    edges: DataFrame, starts: DataFrame, max_hops: int = 3, cut_every: int = 4
) -> DataFrame:
    """All simple paths of at most ``max_hops`` between start tables.

    ``starts`` has ``database_id`` and ``start_tables``, plus any other key such
    as ``question_id``.  Paths stop at their target, parallel keys give separate
    paths, and a repeated start table gives a path of 0 hops.

    A path is found once per (database, source, target), however many questions
    ask for it.  It grows only into tables from which the target can still be
    reached in the hops left, so what is carried is prefixes of real results.
    """
    keys = [c for c in starts.columns if c != "start_tables"]
    asked = start_pairs(starts)
    pairs = cut_lineage(asked.select("database_id", "src", "tgt").distinct())
    # read once per hop and direction, so it is computed once
    adj = cut_lineage(adjacency(edges).filter(F.col("from_table") != F.col("to_table")))

    # tables within h hops of a target, walking backwards
    targets = pairs.select("database_id", "tgt").distinct()
    near = targets.select("database_id", "tgt", F.col("tgt").alias("node"), F.lit(0).alias("left"))
    hop = adj.select(
        "database_id", F.col("to_table").alias("node"), F.col("from_table").alias("next")
    ).distinct()
    ring = near
    for h in range(1, max_hops):
        ring = (
            ring.join(hop, ["database_id", "node"])
            .select("database_id", "tgt", F.col("next").alias("node"))
            .distinct()
            .withColumn("left", F.lit(h))
        )
        near = near.unionByName(ring)
    near = cut_lineage(near.groupBy("database_id", "tgt", "node").agg(F.min("left").alias("left")))

    front = pairs.select(
        "database_id",
        "src",
        "tgt",
        F.col("src").alias("node"),
        F.array("src").alias("tables"),
        F.array().cast(f"array<{STEP}>").alias("path"),
    )
    found = front.filter(F.col("node") == F.col("tgt"))
    front = front.filter(F.col("node") != F.col("tgt"))
    step = adj.select(
        "database_id",
        F.col("from_table").alias("node"),
        F.col("to_table").alias("next"),
        F.struct(*ENDS).alias("step"),
    )
    for h in range(1, max_hops + 1):
        grown = (
            skew_join(front, step, ["database_id", "node"], "inner", ["tgt", "tables"])
            .filter(~F.array_contains(F.col("tables"), F.col("next")))
            .select(
                "database_id",
                "src",
                "tgt",
                F.col("next").alias("node"),
                F.array_append("tables", F.col("next")).alias("tables"),
                F.array_append("path", F.col("step")).alias("path"),
            )
        )
        reach = near.filter(F.col("left") <= max_hops - h).select("database_id", "tgt", "node")
        grown = skew_join(
            grown, reach, ["database_id", "tgt", "node"], "left_semi", ["src", "tables"]
        )
        if h % cut_every == 0:
            grown = cut_lineage(grown)
        found = found.unionByName(grown.filter(F.col("node") == F.col("tgt")))
        front = grown.filter(F.col("node") != F.col("tgt"))
    paths = found.select(
        "database_id", "src", "tgt", "tables", "path", F.size("path").alias("hops")
    )
    return asked.join(paths, ["database_id", "src", "tgt"]).select(
        *keys, "i", "j", "tables", "path", "hops"
    )


def _rings(roots: DataFrame, hop: DataFrame, most: int) -> DataFrame:
    """``database_id, root, node, steps``: what lies within ``most`` hops of each root."""
    near = ring = roots.select("database_id", "root", F.col("root").alias("node"), F.lit(0).alias("steps"))
    for h in range(1, most + 1):
        ring = (
            ring.join(hop, ["database_id", "node"])
            .select("database_id", "root", F.col("next").alias("node"))
            .distinct()
            .withColumn("steps", F.lit(h))
        )
        near = near.unionByName(ring)
    return near.groupBy("database_id", "root", "node").agg(F.min("steps").alias("steps"))


def _halves(roots: DataFrame, step: DataFrame, reach: DataFrame, hops: int, max_hops: int, ahead: bool) -> DataFrame:
    """Simple paths of at most ``hops`` from each root, in both cases written from source to
    target, that can still be part of a whole path: ``reach`` tells how far the other end is."""
    front = roots.select(
        "database_id", "root", F.col("root").alias("node"), F.array("root").alias("tables"),
        F.array().cast(f"array<{STEP}>").alias("path"), F.lit(0).alias("hops"),
    )
    found = front
    for h in range(1, hops + 1):
        add = F.array_append if ahead else F.array_prepend
        grown = (
            skew_join(front, step, ["database_id", "node"], "inner", ["root", "tables"])
            .filter(~F.array_contains(F.col("tables"), F.col("next")))
            .select(
                "database_id", "root", F.col("next").alias("node"), add("tables", F.col("next")).alias("tables"),
                add("path", F.col("step")).alias("path"), F.lit(h).alias("hops"),
            )
        )
        close = reach.filter(F.col("steps") <= max_hops - h).select("database_id", "root", "node")
        front = cut_lineage(
            skew_join(grown, close, ["database_id", "root", "node"], "left_semi", ["tables"])
        )
        found = found.unionByName(front)
    return found


def path_halves(pairs: DataFrame, adj: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """First halves of paths by source, second halves by target; the first is never the
    shorter one, and at most one hop longer."""
    sources = pairs.select("database_id", F.col("src").alias("root")).distinct()
    targets = pairs.select("database_id", F.col("tgt").alias("root")).distinct()
    ends = adj.select("database_id", "from_table", "to_table").distinct()
    onward = ends.select("database_id", F.col("from_table").alias("node"), F.col("to_table").alias("next"))
    back = ends.select("database_id", F.col("to_table").alias("node"), F.col("from_table").alias("next"))

    def other_end(rings: DataFrame, mine: str, theirs: str) -> DataFrame:
        """How far each node is from the nearest of the other ends that a root is paired with."""
        both = pairs.select("database_id", F.col(mine).alias("own"), F.col(theirs).alias("root"))
        return cut_lineage(
            rings.join(both, ["database_id", "root"])
            .groupBy("database_id", F.col("own").alias("root"), "node")
            .agg(F.min("steps").alias("steps"))
        )

    steps = [
        adj.select("database_id", F.col(a).alias("node"), F.col(b).alias("next"), F.struct(*ENDS).alias("step"))
        for a, b in (("from_table", "to_table"), ("to_table", "from_table"))
    ]
    to_target = other_end(_rings(targets, back, max_hops - 1), "src", "tgt")
    to_source = other_end(_rings(sources, onward, max_hops - 1), "tgt", "src")
    first = _halves(sources, steps[0], to_target, -(-max_hops // 2), max_hops, True)
    second = _halves(targets, steps[1], to_source, max_hops // 2, max_hops, False)
    return first, second


def join_paths_both_ends(edges: DataFrame, starts: DataFrame, max_hops: int = 6) -> DataFrame:
    """The rows of ``join_paths``, grown from both ends.

    A path of L hops is the one first half of ceil(L / 2) hops from its source and the one
    second half from its target that meet at a table and share no other, so none is found
    twice.  Halves are found once per source or target, not per pair; around a hub they
    are far fewer than the prefixes of all paths through it.
    """
    keys = [c for c in starts.columns if c != "start_tables"]
    asked = start_pairs(starts)
    pairs = cut_lineage(asked.select("database_id", "src", "tgt").distinct())
    adj = cut_lineage(adjacency(edges).filter(F.col("from_table") != F.col("to_table")))
    apart = pairs.filter(F.col("src") != F.col("tgt"))
    first, second = path_halves(apart, adj, max_hops)
    begun = first.filter("hops > 0").select(
        "database_id", F.col("root").alias("src"), "node", F.col("tables").alias("begin"),
        F.col("path").alias("begin_path"), F.col("hops").alias("n"),
        F.explode(F.array(F.col("hops") - 1, F.col("hops"))).alias("rest"),
    ).filter(F.col("n") + F.col("rest") <= max_hops)
    begun = skew_join(begun, apart, ["database_id", "src"], "inner", ["begin"])
    ended = second.select(
        "database_id", F.col("root").alias("tgt"), "node", F.col("tables").alias("end"),
        F.col("path").alias("end_path"), F.col("hops").alias("rest"),
    )
    met = skew_join(begun, ended, ["database_id", "tgt", "node", "rest"], "inner", ["src", "begin"]).filter(
        F.size(F.array_intersect("begin", "end")) == 1
    )
    paths = met.select(
        "database_id", "src", "tgt",
        F.concat("begin", F.slice("end", F.lit(2), F.size("end"))).alias("tables"),
        F.concat("begin_path", "end_path").alias("path"),
        (F.col("n") + F.col("rest")).alias("hops"),
    )
    same = pairs.filter(F.col("src") == F.col("tgt")).select(
        "database_id", "src", "tgt", F.array("src").alias("tables"),
        F.array().cast(f"array<{STEP}>").alias("path"), F.lit(0).alias("hops"),
    )
    return asked.join(paths.unionByName(same), ["database_id", "src", "tgt"]).select(
        *keys, "i", "j", "tables", "path", "hops"
    )


def path_pairs(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct neighbouring tables of all paths, placed by first occurrence."""
    two = F.filter(
        F.transform(
            F.col("tables"),
            lambda t, i: F.struct(
                i.alias("nth"),
                t.alias("entity"),
                F.get(F.col("tables"), i + 1).alias("related_entities"),
            ),
        ),
        lambda p: p["related_entities"].isNotNull(),
    )
    return (
        paths.select(*keys, "i", "j", "hops", "tables", F.explode(two).alias("p"))
        .groupBy(*keys, "p.entity", "p.related_entities")
        .agg(F.min(F.struct("i", "j", "hops", "tables", "p.nth")).alias("first_seen"))
    )


# ------------------------------------------------------------------ subgraphs


def neighbourhood(relationships: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected tables with parents and children.

    ``selected``: ``database_id``, ``selected_table``.
    """
    out = skew_join(
        relationships.withColumn("selected_table", F.col("from_table")),
        selected,
        ["database_id", "selected_table"],
        "inner",
        ["rel_ordinal"],
    ).select("database_id", "selected_table", F.col("to_table").alias("table_name"))
    back = skew_join(
        relationships.withColumn("selected_table", F.col("to_table")),
        selected,
        ["database_id", "selected_table"],
        "inner",
        ["rel_ordinal"],
    ).select("database_id", "selected_table", F.col("from_table").alias("table_name"))
    own = selected.select(
        "database_id", "selected_table", F.col("selected_table").alias("table_name")
    )
    return own.unionByName(out).unionByName(back).distinct()


def neighbourhood_edges(relationships: DataFrame, near: DataFrame) -> DataFrame:
    """Foreign keys with both ends in the neighbourhood of a selected table."""
    start = near.select("database_id", "selected_table", F.col("table_name").alias("from_table"))
    end = near.select("database_id", "selected_table", F.col("table_name").alias("to_table"))
    both = skew_join(
        relationships, start, ["database_id", "from_table"], "inner", ["rel_ordinal"]
    )
    return skew_join(
        both, end, ["database_id", "selected_table", "to_table"], "left_semi", ["rel_ordinal"]
    ).select("database_id", "selected_table", *ENDS)


def diagram_edges(relationships: DataFrame) -> DataFrame:
    """Parent to child with the id ``<child>-<column>-<parent>-<column>``."""
    return relationships.select(
        "database_id",
        F.concat_ws("-", "from_table", "from_column", "to_table", "to_column").alias("edge_id"),
        F.col("to_table").alias("source"),
        F.col("from_table").alias("target"),
        F.concat(F.lit("source-"), "to_column").alias("source_handle"),
        F.concat(F.lit("target-"), "from_column").alias("target_handle"),
    )


def diagram_nodes(tables: DataFrame) -> DataFrame:
    return tables.select("database_id", F.col("table_name").alias("node_id"))

