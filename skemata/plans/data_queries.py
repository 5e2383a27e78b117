"""Snapshots, browsing, relational workload and streams (M-P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.operators import browse, canonical, snapshot_store, snapshots
from skemata.plans import tenants as T
from skemata.plans import workload
from skemata.plans.registry import query, read
from skemata.session import work_folder
from skemata.sources.documents import parse_raw
from skemata.streaming import flows

NOW = "2030-01-01 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


# ---------------------------------------------------------------- M: snapshots


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """One saved connection per customer."""
    k = F.col("c_custkey")
    tables = F.concat(
        F.lit('{"tables": ['),
        F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.concat(F.lit('{"table_name": "t'), i.cast("string"), F.lit('"}'))), ", "),
        F.lit("]}"),
    )
    vendors = F.array(*[F.lit(v) for v in ("postgres", "mysql", "oracle", "sqlite", "sqlserver")])
    rows = read(spark, sf, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.when(k % 3 != 0, F.concat(F.lit("Market "), F.col("c_mktsegment"))).alias("description"),
        F.get(vendors, (k % 5).cast("int")).alias("database_type"),
        F.when(k % 6 != 0, tables).alias("enriched_schema"),
        F.concat(F.lit('{"b": 1, "a": '), (k % 10).cast("string"), F.lit("}")).alias("insights"),
        F.when(k % 4 == 0, F.lit("archived")).alias("status"),
    )
    made = snapshots.new_connections(rows, now())
    return made.withColumns(
        {
            "created_at": F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=(F.col("id") % 1000).cast("int")),
            "updated_at": F.to_timestamp(F.lit("2024-06-01")),
        }
    )


@query
def new_connections(spark: SparkSession, sf: str) -> DataFrame:
    """M1: inserted rows with their defaults."""
    c = connections(spark, sf)
    return c.select("id", "name", "description", "database_type", "status", "error_message", "created_at",
                    F.length("insights_hash").alias("hash_length"))


@query
def connection_page(spark: SparkSession, sf: str) -> DataFrame:
    """M2: second page of the active connections of one vendor."""
    return snapshots.list_connections(connections(spark, sf), "active", "mysql", limit=5, offset=5)


@query
def connection_search(spark: SparkSession, sf: str) -> DataFrame:
    """M3: ranked search by name or description."""
    return snapshots.search_connections(connections(spark, sf), "Customer#0000000_2", limit=15)


@query
def connection_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """M4: deletes that find their row and deletes that do not, and what is left."""
    c = connections(spark, sf)
    gone = read(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("id"))
    left = snapshots.without(c, gone).select("id", F.lit("kept").alias("state"))
    report = snapshots.delete_report(c, gone).select(
        "id", F.when(F.col("deleted"), F.lit("deleted")).otherwise(F.lit("not found")).alias("state")
    )
    return left.unionAll(report)


def _in_turn(*parts: DataFrame) -> DataFrame:
    """Repeated ids: the parts one after the other."""
    rows = [p.withColumn("turn", F.lit(i)) for i, p in enumerate(parts)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query
def connection_patches(spark: SparkSession, sf: str) -> DataFrame:
    """M5: partial updates; null fields leave values as they are."""
    c = connections(spark, sf)
    s = F.col("s_suppkey")
    patches = read(spark, sf, "supplier").select(
        s.alias("id"),
        F.when(s % 2 == 0, F.col("s_name")).alias("name"),
        F.when(s % 3 == 0, F.lit("error")).alias("status"),
        F.when(s % 3 == 0, F.lit("lost")).alias("error_message"),
    )
    stale = read(spark, sf, "supplier").filter(s % 2 == 0).select(
        s.alias("id"), F.lit("stale").alias("name"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )
    patches = _in_turn(stale, patches)
    return snapshots.patch(c, patches, now(), "turn").select("id", "name", "status", "error_message", "updated_at")


@query
def refreshed_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """M6: new schemas; insights, hash and error are cleared."""
    c = connections(spark, sf)
    new = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit('{"tables": ["'), "s_name", F.lit('"]}')).alias("enriched_schema")
    )
    stale = new.withColumn("enriched_schema", F.lit('{"tables": ["stale"]}'))
    return snapshots.refresh_schema(c, _in_turn(stale, new), now(), order="turn").select(
        "id", "enriched_schema", "insights", F.col("insights_hash").isNull().alias("no_hash"), "status", "updated_at"
    )


@query
def changed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """M7, M8: only payloads with new content are written; key order does not count."""
    c = connections(spark, sf)
    k = F.col("c_custkey")
    new = read(spark, sf, "customer").select(
        k.alias("id"),
        F.concat(F.lit('{"a": '), F.when(k % 4 == 0, F.lit("77")).otherwise((k % 10).cast("string")), F.lit(', "b": 1}')).alias("insights"),
    )
    stale = new.withColumn("insights", F.lit('{"a": "stale"}'))
    return snapshots.write_payloads(c, _in_turn(stale, new), now(), "turn").select("id", "insights", "updated_at")


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Insight items of two runs: parts dropped, added, repeated and repriced."""
    n = F.col("p_partkey")
    base = read(spark, sf, "part").select(
        (n % 20).alias("connection_id"),
        F.col("p_type").alias("category"),
        F.get(F.array(*[F.lit(s) for s in snapshots.ITEM_SECTIONS]), (F.col("p_size") % 4).cast("int")).alias("section"),
        n.alias("ordinal"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )
    n, size = F.col("ordinal"), F.col("size")
    old = base.filter(n % 5 != 0)
    new = base.filter(n % 7 != 0).withColumn("size", F.when(n % 3 == 0, size + 100).otherwise(size))
    return snapshots.item_hashes(old, ["name", "size"]), snapshots.item_hashes(new, ["name", "size"])


ITEM_KEY = ["connection_id", "category", "section"]


@query
def snapshot_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Change of every item, per section."""
    old, new = _items(spark, sf)
    delta = snapshots.item_delta(old, new, ITEM_KEY)
    return delta.groupBy(*ITEM_KEY, "change").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("ordinals")
    )


@query
def changed_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections whose list differs, per category."""
    old, new = _items(spark, sf)
    return snapshots.changed_sections(old, new, ["connection_id", "category"])


def _stored_items(spark: SparkSession, sf: str) -> list[str]:
    paths = [work_folder(spark, name) for name in ("snapshot-old", "snapshot-new")]
    for items, path in zip(_items(spark, sf), paths, strict=True):
        snapshot_store.write_snapshot(items, path, ITEM_KEY)
    return paths


@query
def snapshot_delta_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from stored snapshots, which opens only folders that differ."""
    return snapshot_store.delta_counts(spark, *_stored_items(spark, sf), ITEM_KEY)


@query
def changed_sections_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the digests of stored snapshots."""
    return snapshot_store.changed_sections(spark, *_stored_items(spark, sf), ["connection_id", "category"])


@query
def merged_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories not generated again keep their items."""
    old, new = _items(spark, sf)
    some = new.filter(F.col("category").isin("ECONOMY", "PROMO"))
    return snapshots.merge_categories(old, some).select(*ITEM_KEY, "ordinal", "name", "size")


@query
def failed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that fail keep their row and say why."""
    k = F.col("c_custkey")
    texts = read(spark, sf, "customer").select(
        k.alias("id"),
        F.when(k % 5 == 0, F.lit('{"tables": ['))
        .when(k % 5 == 1, F.lit(" "))
        .when(k % 5 == 2, F.lit('{"tables": 5}'))
        .when(k % 5 == 3, F.lit("[1]"))
        .otherwise(F.concat(F.lit('{"tables": [], "schema": "'), "c_name", F.lit('"}')))
        .alias("document"),
    )
    return snapshots.capture_failures(texts)


# ----------------------------------------------------------------- N: browsing


@query
def browse_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per database."""
    cat = T.catalog(spark, sf)
    flagged = canonical.flagged_columns(cat.columns, cat.constraints)
    return browse.overview(
        cat.databases, cat.tables, cat.views, flagged, cat.relationships, cat.constraints
    )


@query
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    """Tables and views by part of their name."""
    cat = T.catalog(spark, sf)
    return browse.search_names(cat.tables, cat.views, "ORDER")


@query
def connection_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Connections by part of name, description or vendor."""
    return browse.search_connections(connections(spark, sf), "SQL").select("id", "name", "database_type")


@query
def column_details(spark: SparkSession, sf: str) -> DataFrame:
    """Constraints, references and flags of every column."""
    cat = T.catalog(spark, sf)
    return browse.column_details(cat.columns, cat.constraints, cat.relationships)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).when(
        F.col("event_type") == "purchase", F.lit("WARNING")
    ).when(F.col("event_type") == "view", F.lit("DEBUG")).otherwise(F.lit("INFO"))
    return read(spark, sf, "events").select(
        F.col("event_id").alias("seq"), level.alias("level"), F.col("props").alias("message")
    )


@query
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Last 50 lines at or above WARNING of the whole log."""
    return browse.log_tail(_log(spark, sf), 50, "warning")


@query
def ready_connections(spark: SparkSession, sf: str) -> DataFrame:
    """Connections insights can be made for."""
    return browse.ready_for_insights(connections(spark, sf)).select("id")


# ----------------------------------------------------------------- O: workload


def star(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return {n: read(spark, sf, n) for n in names}


@query
def view_order_places(spark: SparkSession, sf: str) -> DataFrame:
    """O1"""
    return workload.order_places(star(spark, sf))


@query
def view_finished_orders(spark: SparkSession, sf: str) -> DataFrame:
    """O2"""
    return workload.finished_orders(star(spark, sf))


@query
def view_customer_activity(spark: SparkSession, sf: str) -> DataFrame:
    """O3"""
    return workload.customer_activity(star(spark, sf))


@query
def view_order_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """O4"""
    return workload.order_tracking(star(spark, sf))


@query
def view_line_details(spark: SparkSession, sf: str) -> DataFrame:
    """O5"""
    return workload.line_details(star(spark, sf))


@query
def ask_orders_of_segment(spark: SparkSession, sf: str) -> DataFrame:
    """O6"""
    return workload.orders_of_segment(star(spark, sf))


@query
def ask_parts_of_type(spark: SparkSession, sf: str) -> DataFrame:
    """O7"""
    return workload.parts_of_type(star(spark, sf))


@query
def ask_order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """O8"""
    return workload.order_counts(star(spark, sf))


@query
def ask_orders_due(spark: SparkSession, sf: str) -> DataFrame:
    """O9"""
    return workload.orders_due(star(spark, sf))


@query
def ask_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """O10"""
    return workload.kpi_values(star(spark, sf))


# ------------------------------------------------------------------ P: streams


# Events of one arriving file at most, where their ids are spread evenly.
EVENTS_PER_FILE = 1_000_000


def _arriving(spark: SparkSession, sf: str, files: int = 10) -> DataFrame:
    """The events as a stream: files that arrive one after the other, one per batch, in
    the order of their ids; events without an id come first.

    The table is read once and dealt into slices; each slice is then one file."""
    events = read(spark, sf, "events")
    low, high, n = events.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    files = max(files, -(-n // EVENTS_PER_FILE))
    part = F.floor((F.col("event_id") - F.lit(low)) * files / F.lit((high or 0) - (low or 0) + 1))
    staged, folder = work_folder(spark, "slices"), work_folder(spark, "events")
    sliced = events.withColumn("slice", F.coalesce(part.cast("int"), F.lit(0)))
    sliced.repartition("slice").write.partitionBy("slice").parquet(staged)
    slices = spark.read.schema(sliced.schema).parquet(staged)
    for i in range(files):
        slices.filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _document_files(spark: SparkSession, sf: str) -> str:
    """Raw documents of all tenants as JSON lines."""
    folder = work_folder(spark, "documents")
    T.raw_documents(spark, sf).drop("database_id").write.json(folder)
    return folder


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of arriving documents."""
    docs = flows.document_stream(spark, _document_files(spark, sf))
    named = flows.ingest_columns(docs.withColumn("database_id", F.regexp_extract("schema", r"(\d+)", 1).cast("bigint")))
    out = work_folder(spark, "columns")
    flows.append(named, out, work_folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rule labels and pattern hits of arriving columns."""
    docs = flows.document_stream(spark, _document_files(spark, sf))
    docs = docs.withColumn("database_id", F.regexp_extract("schema", r"(\d+)", 1).cast("bigint"))
    labelled, hits = work_folder(spark, "labels"), work_folder(spark, "hits")
    first = flows.append(flows.label_columns(docs), labelled, work_folder(spark, "progress"))
    second = flows.append(flows.label_patterns(docs), hits, work_folder(spark, "progress"))
    first.awaitTermination()
    second.awaitTermination()
    found = spark.read.parquet(hits).select("database_id", "table_name", "column_name", "pattern")
    return (
        spark.read.parquet(labelled)
        .join(found, ["database_id", "table_name", "column_name"], "left")
        .select("database_id", "table_name", "column_name", "classification", "confidence", "pattern")
    )


@query
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Last event of every user."""
    out = work_folder(spark, "state")
    flows.upsert_stream(
        _arriving(spark, sf), ["user_id"], ["event_id"], out, work_folder(spark, "progress")
    ).awaitTermination()
    return flows.upserted(spark, out, ["user_id"], ["event_id"]).select(
        "user_id", "event_id", "event_type", "value"
    )


@query
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose type differs from the user's event before."""
    out = work_folder(spark, "changes")
    flows.changed_stream(
        _arriving(spark, sf), ["user_id"], "event_id", "event_type", out, work_folder(spark, "progress")
    ).awaitTermination()
    return spark.read.option("basePath", out).parquet(out).drop("batch_id")


@query
def stream_log_tail(spark: SparkSession, sf: str) -> DataFrame:
    """P5: log lines as they arrive, then their tail."""
    out = work_folder(spark, "log")
    events = _arriving(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.col("props").alias("message"),
    )
    flows.log_stream(events, out, work_folder(spark, "progress")).awaitTermination()
    return browse.log_tail(flows.log_buffer(spark, out), 100, "ERROR")


@query
def parsed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A1: documents held as JSON text, parsed and flattened."""
    docs = T.raw_documents(spark, sf)
    texts = docs.select("database_id", F.to_json(F.struct(*[c for c in docs.columns if c != "database_id"])).alias("document"))
    return canonical.canonicalise(parse_raw(texts)).columns.select(
        "database_id", "table_name", "column_name", "is_nullable", "is_primary_key"
    )
