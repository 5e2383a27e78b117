"""Audit of SQL text against the catalog.

A log of statements is exploded to references, and references are checked by joins.
Whole statements are scanned by ``functions.sqltokens``; answers, references of items and
name-like words go by the patterns of ``functions.sqltext``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemata.functions.sqltext import extract_sql, identifier_tokens, is_stand_in, table_refs
from skemata.functions.sqltokens import (
    in_context,
    qualified_names,
    scanned,
    split_statements,
    sql_tokens,
    statement_bounds,
    used_names,
)
from skemata.functions.text import strip
from skemata.scale import skew_join

TABLE_KEY = ["database_id", "table_name"]

# Confidences and reasons.
GENERATED_CONFIDENCE = 0.8
DANGEROUS_CONFIDENCE = 0.5
WARNED_CONFIDENCE = 0.8
NO_TABLES = "Question cannot be answered using the available database schema — no matching tables found."
NO_ANSWER = "Question cannot be answered using the available database schema."
MODEL_DECLINED = "Question cannot be answered using the "
UNKNOWN_PARTS = (
    "Question cannot be answered using the available database schema — generated SQL references "
    "unknown schema elements."
)
EMPTY_STATEMENT = "Empty or None SQL statement"
BAD_STATEMENT = "SQL syntax error: not a statement"


def statement_refs(log: DataFrame, sql: str = "sql", strict: bool = False) -> DataFrame:
    """One row per statement and table it names, in lower case."""
    return log.select(
        "database_id", "query_id", F.explode(table_refs(F.col(sql), strict=strict)).alias("table_name")
    )


def statement_tokens(log: DataFrame, text: str = "sql") -> DataFrame:
    return log.select(
        "database_id", "query_id", F.explode(identifier_tokens(F.col(text))).alias("token")
    )


# -------------------------------------------------------------------- grounding


def _known_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(F.col("table_name") != "").select(
        "database_id", F.lower("table_name").alias("table_name")
    ).distinct()


def ungrounded_refs(items: DataFrame, tables: DataFrame, sql: str = "sql_query") -> DataFrame:
    """References of items to tables their database lacks.

    Databases without any table reject nothing.
    """
    refs = items.select(
        "database_id", "item_id", F.explode(table_refs(F.col(sql))).alias("table_name")
    )
    known = _known_tables(tables)
    lost = skew_join(refs, known, TABLE_KEY, "left_anti", ["item_id"])
    return skew_join(
        lost, known.select("database_id").distinct(), ["database_id"], "left_semi", ["item_id"]
    )


def grounded_items(items: DataFrame, tables: DataFrame, sql: str = "sql_query") -> DataFrame:
    """Items whose SQL names only tables of the catalog."""
    bad = ungrounded_refs(items, tables, sql).select("database_id", "item_id").distinct()
    return items.join(bad, ["database_id", "item_id"], "left_anti")


def unknown_identifiers(
    items: DataFrame, text: Column, tables: DataFrame, columns: DataFrame
) -> DataFrame:
    """Name-like words of item texts that are neither table nor column; for information."""
    words = items.select(
        "database_id", "item_id", F.explode(identifier_tokens(text)).alias("token")
    )
    known = (
        _known_tables(tables)
        .select("database_id", F.col("table_name").alias("token"))
        .unionAll(columns.select("database_id", F.lower("column_name").alias("token")))
        .distinct()
    )
    return skew_join(words, known, ["database_id", "token"], "left_anti", ["item_id"])


# ---------------------------------------------------------------- model answers


def answer_status(answers: DataFrame) -> DataFrame:
    """``answers``: question_id, answer, table_count (of its context).

    Adds status, sql, reason, explanation and generation confidence.
    """
    text = strip(F.coalesce("answer", F.lit("")))
    declined = F.startswith(F.upper(text), F.lit("OUT_OF_SCOPE"))
    said = strip(F.substring(text, F.lit(len("OUT_OF_SCOPE:") + 1), F.length(text)))
    sql = extract_sql(F.col("answer"))
    kind = (
        F.when(F.coalesce("table_count", F.lit(0)) == 0, F.lit("no tables"))
        .when(declined, F.lit("declined"))
        .when(sql == "", F.lit("no sql"))
        .when(is_stand_in(sql), F.lit("stand-in"))
        .otherwise(F.lit("sql"))
    )
    rows = answers.withColumns({"__kind": kind, "__sql": sql, "__said": said})
    is_sql = F.col("__kind") == "sql"
    return rows.select(
        *answers.columns,
        F.when(is_sql, F.lit("SUCCESS")).otherwise(F.lit("OUT_OF_SCOPE")).alias("status"),
        F.when(is_sql, F.col("__sql")).otherwise(F.lit("")).alias("sql"),
        F.when(F.col("__kind") == "no tables", F.lit(NO_TABLES))
        .when(
            F.col("__kind") == "declined",
            F.when(F.col("__said") == "", F.lit(MODEL_DECLINED)).otherwise(F.col("__said")),
        )
        .when(~is_sql, F.lit(NO_ANSWER))
        .alias("reason"),
        F.when(F.col("__kind") == "no sql", F.lit("LLM did not return a valid SQL statement"))
        .when(
            F.col("__kind") == "stand-in",
            F.lit("LLM returned placeholder SQL instead of a real query"),
        )
        .alias("explanation"),
        F.when(is_sql, F.lit(GENERATED_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
    )


# ------------------------------------------------------------------- validation


def statements(log: DataFrame, sql: str = "sql", only_first: bool = True) -> DataFrame:
    """Statements of each log entry as token arrays, cut at semicolons outside literals,
    quoted names and comments.

    The first one only, as a validator sees it, or all of them.  Blank entries
    stay as one statement without tokens.
    """
    others = [c for c in log.columns if c != sql]
    rows = log.select(*others, sql_tokens(F.col(sql)).alias("all"))
    rows = rows.withColumn("bounds", statement_bounds(F.col("all")))
    pieces = split_statements(F.col("all"), F.col("bounds"))
    if only_first:
        pieces = F.slice(pieces, 1, 1)
    rows = rows.select(*others, F.posexplode_outer(pieces).alias("statement_no", "tokens"))
    return rows.select(
        *others,
        F.coalesce("statement_no", F.lit(0)).alias("statement_no"),
        in_context(F.coalesce("tokens", F.array().cast(rows.schema["tokens"].dataType))).alias("tokens"),
    )


def audit_statements(
    log: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    only_first: bool = True,
    warned: Column | None = None,
    with_names: bool = True,
) -> DataFrame:
    """Errors, dangers, confidence and a summary for every statement.

    ``log``: database_id, query_id, sql.  ``warned`` flags statements another
    dialect would spell differently.  A name that a WITH defines counts as a table, as a
    validator without scopes has it, unless ``with_names`` is False.

    A statement is scanned once; its tables, qualified names and words then meet the
    catalog in one pass of joins.
    """
    key = ["database_id", "query_id", "statement_no"]
    kept = [c for c in log.columns if c not in ("database_id", "query_id", "sql")]
    rows = statements(log, only_first=only_first).withColumn("found", scanned(F.col("tokens")))
    rows = rows.select(
        *key,
        *kept,
        (F.size("tokens") == 0).alias("blank"),
        "found.broken",
        "found.kind",
        "found.danger",
        F.col("found.tables" if with_names else "found.own_tables").alias("tables"),
        qualified_names(F.col("tokens")).alias("pairs"),
        used_names(F.col("tokens")).alias("words"),
    )
    text = F.lit(None).cast("string")
    # tables, qualified names, words with each table of their statement, and one row that
    # keeps a statement without any of these
    refs = F.concat(
        F.array(F.struct(F.lit("statement").alias("use"), text.alias("owner"), text.alias("name"))),
        F.transform("tables", lambda t: F.struct(F.lit("table").alias("use"), t.alias("owner"), text.alias("name"))),
        F.transform("pairs", lambda p: F.struct(F.lit("pair").alias("use"), p["owner"].alias("owner"), p["name"].alias("name"))),
        F.flatten(
            F.transform(
                "tables",
                lambda t: F.transform(
                    "words", lambda w: F.struct(F.lit("word").alias("use"), t.alias("owner"), w.alias("name"))
                ),
            )
        ),
    )
    facts = [*kept, "blank", "broken", "kind", "danger", "tables"]
    uses = rows.select(*key, F.struct(*facts).alias("fact"), F.explode(refs).alias("ref")).select(
        *key, F.when(F.col("ref.use") == "statement", F.col("fact")).alias("fact"), "ref.*"
    )
    known = tables.select("database_id", F.col("table_name").alias("owner"), F.lit(True).alias("known")).distinct()
    names = columns.select(
        "database_id", F.col("table_name").alias("owner"), F.col("column_name").alias("name"), F.lit(True).alias("held")
    ).distinct()
    spread = ["query_id", "statement_no"]
    met = skew_join(uses, known, ["database_id", "owner"], "left", spread)
    met = skew_join(met, names, ["database_id", "owner", "name"], "left", spread)
    use, no_table, no_column = F.col("use"), F.col("known").isNull(), F.col("held").isNull()
    message = F.when(
        (use == "table") & no_table,
        F.struct(F.lit(0).alias("order"), F.concat(F.lit("Table '"), "owner", F.lit("' not found in enriched metadata")).alias("text")),
    ).when(
        (use == "pair") & ~no_table & no_column,
        F.struct(F.lit(1).alias("order"), F.concat(F.lit("Column '"), "name", F.lit("' not found in table '"), "owner", F.lit("'")).alias("text")),
    )
    used = F.collect_set(F.when((use == "word") & ~no_column, F.col("name")))
    judged = met.groupBy(*key).agg(
        F.first("fact", ignorenulls=True).alias("fact"),
        F.transform(F.array_sort(F.collect_set(message)), lambda m: m["text"]).alias("lost"),
        F.array_join(F.array_sort(used), ",").alias("used"),
    )
    errors = (
        F.when(F.col("fact.blank"), F.array(F.lit(EMPTY_STATEMENT)))
        .when(F.col("fact.broken"), F.array(F.lit(BAD_STATEMENT)))
        .otherwise(F.col("lost"))
    )
    clean = F.size("__e") == 0
    return (
        judged.withColumns(
            {"__e": errors, "__d": F.when(~F.col("fact.broken"), F.col("fact.danger"))}
        )
        .select(*judged.columns, "__e", "__d", *[F.col(f"fact.{c}").alias(c) for c in kept])
        .select(
            *key,
            *kept,
            clean.alias("is_valid"),
            F.concat_ws("; ", "__e", "__d").alias("errors"),
            F.when(~clean, F.lit(0.0))
            .when(F.col("__d").isNotNull(), F.lit(DANGEROUS_CONFIDENCE))
            .when(F.lit(False) if warned is None else warned, F.lit(WARNED_CONFIDENCE))
            .otherwise(F.lit(1.0))
            .alias("confidence"),
            F.when(clean, F.col("fact.kind")).alias("statement_type"),
            F.when(clean, F.array_join(F.array_sort("fact.tables"), ",")).alias("tables_used"),
            F.when(clean, F.col("used")).alias("columns_used"),
        )
    )


def final_response(generated: DataFrame, audited: DataFrame) -> DataFrame:
    """Last word on an answer: what is unknown to the schema is out of scope."""
    checked = audited.filter("statement_no = 0").select(
        "query_id", "is_valid", F.col("confidence").alias("checked")
    )
    ok = F.col("status") == "SUCCESS"
    bad = ok & ~F.coalesce("is_valid", F.lit(True))
    out = F.when(ok & ~bad, F.lit("SUCCESS")).otherwise(F.lit("OUT_OF_SCOPE"))
    return generated.join(checked, "query_id", "left").select(
        "query_id",
        out.alias("status"),
        F.when(ok & ~bad, F.col("sql")).otherwise(F.lit("")).alias("sql"),
        F.when(bad, F.lit(UNKNOWN_PARTS)).otherwise(F.col("reason")).alias("reason"),
        F.when(ok & ~bad & (F.col("sql") != ""), F.least("confidence", "checked"))
        .otherwise(F.lit(0.0))
        .alias("confidence"),
    )
