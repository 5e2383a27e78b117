"""SQL text audit and insight datasets (K, L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.functions.sqltext import extract_sql, identifier_tokens, is_stand_in, table_refs
from skemata.operators import assemble, audit, insights
from skemata.plans import tenants as T
from skemata.plans.catalog_queries import enriched
from skemata.plans.registry import query, read

# Statements of the log; {id} is the event, {user} its user, {value} its value.
STATEMENTS = [
    "SELECT c_name FROM customer WHERE c_custkey = {user}",
    "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey;",
    "DELETE FROM orders",
    "UPDATE part SET p_size = 1 WHERE p_partkey = {id}",
    "DROP TABLE lineitem",
    "SELECT * FROM ghost_table JOIN nation ON n_nationkey = {user}",
    "SELECT customer.nope, customer.c_custkey FROM customer",
    "   ",
    "WITH t AS (SELECT 1 AS x FROM part) SELECT x FROM t",
    "SELECT 'DROP TABLE x' AS note, n_nationkey FROM nation -- DELETE FROM y",
    "Select P_NAME From part Where p_partkey > {value}",
    "TRUNCATE TABLE events; SELECT 1",
    "UPDATE orders SET o_custkey = 0",
    "INSERT INTO supplier VALUES (1); SELECT s_suppkey FROM supplier",
    "INSERT INTO TABLE part SELECT * FROM supplier",
    "SELECT EXTRACT(YEAR FROM o_orderdate) FROM orders",
    "SELECT p_size FROM public.part",
    'SELECT * FROM "ghost"',
    "SELECT o_orderkey FROM orders, ghost",
    "SELECTT * FROM orders",
    "SELECT * FORM orders",
    "SELECT WHERE",
    "WITH d AS (DELETE FROM orders RETURNING 1) SELECT o_orderkey FROM orders",
    "SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier",
    "SELECT n_name AS c_name FROM nation, customer",
    "SELECT a FROM (SELECT o_orderkey AS a FROM orders) x, ghost",
    "MERGE INTO orders USING ghost ON o_orderkey = id WHEN MATCHED THEN DELETE",
    "SELECT * FROM `ghost`",
    "SELECT * FROM [ghost]",
    "DELETE FROM orders USING ghost WHERE o_orderkey = 1",
    "SELECT 1 FROM orders WHERE",
    "SELECT * FROM orders JOIN",
    "SELECT * FROM orders,",
    "SELECT COUNT( FROM orders",
    "SELECT 1 FROM orders WHERE (o_orderkey = 1",
    'SELECT "a from ghost" FROM orders',
    "SELECT $$ from ghost $$ FROM orders",
    "SELECT g FROM generate_series(1, 10) AS t (g)",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT n FROM r JOIN orders ON n = o_orderkey",
    "SELECT o_orderkey FROM orders WHERE o_orderkey = AND 1 = 1",
    "SELECT o.o_orderkey FROM (orders o JOIN ghost g ON g.id = o.o_orderkey)",
    "UPDATE part SET p_size = (SELECT 1 FROM ghost)",
]
# Answers around a statement; {sql} is the statement.
WRAPPINGS = [
    "{sql}",
    "Sure:\n```sql\n{sql}\n```\nDone.",
    "SQL: {sql}",
    "OUT_OF_SCOPE: no such data",
    "I cannot say.",
    "SELECT 0 AS nothing;",
    "OUT_OF_SCOPE",
]


def _filled_in(texts: list[str], pick: Column, parts: dict[str, Column]) -> Column:
    chosen = F.get(F.array(*[F.lit(t) for t in texts]), pick.cast("int"))
    for name, value in parts.items():
        chosen = F.replace(chosen, F.lit("{" + name + "}"), value)
    return chosen


def sql_log(spark: SparkSession, sf: str) -> DataFrame:
    """One statement per event, of the database with the user's number."""
    events = read(spark, sf, "events")
    sql = _filled_in(
        STATEMENTS,
        F.col("event_id") % len(STATEMENTS),
        {
            "id": F.col("event_id").cast("string"),
            "user": F.col("user_id").cast("string"),
            "value": F.floor("value").cast("string"),
        },
    )
    return events.select(F.col("user_id").alias("database_id"), F.col("event_id").alias("query_id"), sql.alias("sql"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """The same statements as model answers."""
    log = sql_log(spark, sf)
    return log.select(
        "database_id",
        "query_id",
        _filled_in(WRAPPINGS, F.col("query_id") % 37 % len(WRAPPINGS), {"sql": F.col("sql")}).alias("answer"),
        F.when(F.col("query_id") % 41 == 0, F.lit(0)).otherwise(F.lit(3)).alias("table_count"),
    )


@query
def sql_table_refs(spark: SparkSession, sf: str) -> DataFrame:
    """K1: tables named by every statement, also without WITH names."""
    log = sql_log(spark, sf)
    return log.select(
        "query_id",
        F.array_join(F.array_sort(table_refs(F.col("sql"))), ",").alias("refs"),
        F.array_join(F.array_sort(table_refs(F.col("sql"), strict=True)), ",").alias("strict_refs"),
    )


@query
def text_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """K2: name-like tokens of whole documents, with a few planted ones."""
    docs = read(spark, sf, "documents")
    text = F.concat(F.lit("see order_line, ORDER_LINE and OrderLine: "), F.col("text"))
    return docs.select("doc_id", F.array_join(F.array_sort(identifier_tokens(text)), ",").alias("tokens"))


def kpi_items(spark: SparkSession, sf: str) -> DataFrame:
    """One KPI per part, of the database with its number modulo the supplier count."""
    parts = read(spark, sf, "part")
    n = F.col("p_partkey")
    table = F.when(n % 3 == 0, F.lit("orders")).when(n % 3 == 1, F.lit("Part")).otherwise(F.lit("part_ledger"))
    return parts.select(
        (n % 100).alias("database_id"),
        n.alias("item_id"),
        F.concat(F.lit("Sales of "), F.col("p_brand")).alias("name"),
        F.concat(F.lit("Counts o_orderkey by p_size and big_spender, e.g. "), F.col("p_type")).alias("description"),
        F.concat(F.lit("SELECT count(*) FROM "), table, F.lit(" JOIN customer ON 1 = 1")).alias("sql_query"),
    )


@query
def grounded_items(spark: SparkSession, sf: str) -> DataFrame:
    """K3: items whose SQL names only tables of their database."""
    return audit.grounded_items(kpi_items(spark, sf), T.catalog(spark, sf).tables).select(
        "database_id", "item_id", "sql_query"
    )


@query
def unknown_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """K4: words of item texts that name nothing in the database."""
    cat = T.catalog(spark, sf)
    text = F.concat_ws(" ", "name", "description")
    return audit.unknown_identifiers(kpi_items(spark, sf), text, cat.tables, cat.columns)


@query
def extracted_sql(spark: SparkSession, sf: str) -> DataFrame:
    """K5, K6: statement inside every answer, and whether it is a stand-in."""
    sql = extract_sql(F.col("answer"))
    return answers(spark, sf).select("query_id", sql.alias("sql"), is_stand_in(sql).alias("stand_in"))


@query
def answer_status(spark: SparkSession, sf: str) -> DataFrame:
    """K7: status of every answer."""
    return audit.answer_status(answers(spark, sf)).select(
        "query_id", "status", "sql", "reason", "explanation", "confidence"
    )


@query
def sql_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Errors, dangers, confidence and summary of every statement."""
    cat = T.catalog(spark, sf)
    return audit.audit_statements(sql_log(spark, sf), cat.tables, cat.columns)


@query
def sql_audit_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same for every statement of an entry, not just its first."""
    cat = T.catalog(spark, sf)
    return audit.audit_statements(
        sql_log(spark, sf), cat.tables, cat.columns, only_first=False
    ).select("query_id", "statement_no", "is_valid", "confidence")


@query
def sql_audit_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """The same, where names that a WITH defines are no tables."""
    cat = T.catalog(spark, sf)
    return audit.audit_statements(sql_log(spark, sf), cat.tables, cat.columns, with_names=False)


@query
def final_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Last word on every answer."""
    cat = T.catalog(spark, sf)
    generated = audit.answer_status(answers(spark, sf))
    checked = audit.audit_statements(
        generated.select("database_id", "query_id", "sql"), cat.tables, cat.columns
    )
    return audit.final_response(generated, checked)


# ----------------------------------------------------------------- L: insights


@query
def schema_context(spark: SparkSession, sf: str) -> DataFrame:
    """L1: context text of every database, by section."""
    tables, columns = enriched(spark, sf)
    lab = T.labels(spark, sf)
    return insights.schema_context(
        tables, columns, T.catalog(spark, sf).relationships, lab.entity_relationships,
        assemble.process_texts(assemble.business_processes(tables)),
        lab.use_cases, lab.sample_queries,
    )


@query
def domain_scope(spark: SparkSession, sf: str) -> DataFrame:
    """L2: focus text for a domain, an unknown domain, an entity, or none."""
    k = F.col("database_id")
    asked = T.customers(spark, sf).select(
        k.alias("request_id"),
        "database_id",
        F.when(k % 4 == 0, F.lit("reference data")).when(k % 4 == 1, F.lit("Astronomy")).alias("domain"),
        F.when(k % 3 == 0, F.lit("customer")).alias("entity"),
    )
    return insights.domain_scope(asked, enriched(spark, sf)[0], T.labels(spark, sf).entity_relationships)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One nested payload per customer; every fifth one in the older flat form."""
    k = F.col("c_custkey")
    flat = F.concat(
        F.lit('{"kpis": [{"name": "n'), k.cast("string"),
        F.lit('", "category": null}], "insights": [{"finding": "f", "confidence": 0.5}, {"impact": "i"}],'
              ' "opportunities": [], "art_of_the_possible": [{"title": "t'), k.cast("string"), F.lit('"}]}'),
    )
    nested = F.concat(F.lit('{"Finance": '), flat, F.lit(', "Sales": {"kpis": [], "insights": [{"finding": "s"}]}}'))
    return read(spark, sf, "customer").select(
        k.alias("connection_id"), F.when(k % 5 == 0, flat).otherwise(nested).alias("payload")
    )


@query
def insight_rows(spark: SparkSession, sf: str) -> DataFrame:
    """L3: items of all payloads as typed rows."""
    items = insights.payload_items(payloads(spark, sf))
    out = None
    for section, fields in insights.SECTIONS.items():
        rows = insights.section_rows(items, section).select(
            "connection_id", F.col("category_name").alias("category_name"), F.lit(section).alias("section"),
            "ordinal", F.concat_ws("|", *[F.col(f).cast("string") for f in fields]).alias("fields"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


@query
def category_runs(spark: SparkSession, sf: str) -> DataFrame:
    """L4: items per category of every connection, empty where a run failed."""
    items = insights.payload_items(payloads(spark, sf))
    return insights.category_runs(payloads(spark, sf), items)
