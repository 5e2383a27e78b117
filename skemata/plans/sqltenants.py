"""The tenant catalog once more, as plain SQL for a second engine."""

from __future__ import annotations

from skemata.functions.rules import PII_RULES, SEMANTIC_RULES, is_regex
from skemata.plans import tenants as T


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def tname(base: str) -> str:
    return (
        f"CASE WHEN k % 7 = 0 THEN upper(substr({base}, 1, 1)) || substr({base}, 2) ELSE {base} END"
    )


CNAME = (
    "CASE WHEN is_key THEN c"
    " WHEN is_last AND k % 4 = 0 AND t % 2 = 0 THEN 'created_at'"
    " WHEN is_last AND k % 4 = 1 AND t % 2 = 0 THEN 'status'"
    " WHEN is_last AND k % 4 = 2 AND t % 2 = 1 THEN 'Tenant_ID' "
    + " ".join(f"WHEN (k * 3 + g) % 17 = {n} THEN c || '{s}'" for n, s in T.SUFFIXES.items())
    + " ELSE c END"
)

SNAKE = "'^[a-z][a-z0-9]*(_[a-z0-9]+)*$'"


def matches(pattern: str, col: str) -> str:
    if is_regex(pattern):
        return f"regexp_matches({col}, '(?i){pattern}')"
    return f"contains(lower({col}), '{pattern.lower()}')"


def rule_case(col: str, field: str, rules) -> str:
    whens = " ".join(
        f"WHEN {matches(r.pattern, col)} THEN {lit(getattr(r, field))}" for r in rules
    )
    default = "NULL" if field == "label" else "0.0"
    return f"CASE {whens} ELSE {default} END"


ALL_RULES = [*PII_RULES, *SEMANTIC_RULES]

ROLE_CASE = "CASE (k + t) % 9 " + " ".join(
    f"WHEN {i} THEN '{r}'" for i, r in enumerate(T.ROLES)
) + " END"

PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "base_cols": (values("base_cols", "t, tbl, p, g, c, dtype, pk, is_key, is_last", T.base_columns()), ()),
    "base_fks": (values("base_fks", "f, child, child_col, parent, parent_col", T.base_keys()), ()),
    "base_tabs": (
        values("base_tabs", "t, tbl", [(t, n) for t, n, _ in T.base_tables()] + [(14, T.STUB_TABLE)]),
        (),
    ),
    "dbs": (
        "dbs AS (SELECT c_custkey AS database_id, c_custkey AS k, c_mktsegment AS segment,"
        " CASE WHEN c_custkey % 23 = 5 THEN '' ELSE 'postgresql' END AS vendor,"
        " 'tenant_' || c_custkey AS name,"
        " CASE c_custkey % 3 WHEN 0 THEN '15.0' WHEN 1 THEN '14.2' END AS version,"
        " c_custkey % 97 <> 96 AS has_tables FROM customer)",
        (),
    ),
    "tabs": (
        f"tabs AS (SELECT database_id, k, segment, t, CAST(t AS BIGINT) AS table_ordinal, {tname('tbl')} AS table_name"
        " FROM dbs CROSS JOIN base_tabs WHERE has_tables AND (t < 14 OR k % 17 = 0))",
        ("dbs", "base_tabs"),
    ),
    "cols": (
        f"cols AS (SELECT database_id, k, t, g, CAST(g AS BIGINT) AS column_ordinal, CAST(t AS BIGINT) AS table_ordinal,"
        f" {tname('tbl')} AS table_name, CAST(p AS BIGINT) AS position, {CNAME} AS column_name, dtype AS data_type,"
        " (k + g) % 5 <> 2 AS is_nullable, pk AND NOT (k % 5 = 0 AND t % 3 = 1) AS is_primary_key"
        f" FROM dbs CROSS JOIN base_cols WHERE has_tables AND (g < {T.N_BASE} OR k % 13 = 0))",
        ("dbs", "base_cols"),
    ),
    "rels": (
        f"rels AS (SELECT database_id, k, f, CAST(f AS BIGINT) AS rel_ordinal, {tname('child')} AS from_table,"
        " child_col AS from_column,"
        f" CASE WHEN f = 4 AND k % 11 = 0 THEN 'missing_customer' ELSE {tname('parent')} END AS to_table,"
        " parent_col AS to_column,"
        " CASE WHEN f = 6 AND k % 9 = 4 THEN NULL"
        f" WHEN k % 3 = 0 THEN 'fk_' || ({tname('child')}) || '_' || child_col"
        f" ELSE ({tname('child')}) || '_' || child_col || '_fkey' END AS constraint_name"
        " FROM dbs CROSS JOIN base_fks WHERE has_tables AND (f <> 3 OR k % 8 = 0) AND (f <> 8 OR k % 6 = 0))",
        ("dbs", "base_fks"),
    ),
    "vws": (
        "vws AS (SELECT database_id, CAST(0 AS BIGINT) AS view_ordinal, 'v_orders' AS view_name,"
        f" {lit(T.ORDER_VIEW)} AS definition FROM dbs WHERE has_tables AND k % 2 = 0 UNION ALL"
        " SELECT database_id, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, 'v_parts', '' FROM dbs WHERE has_tables AND k % 3 = 0)",
        ("dbs",),
    ),
    "tlab": (
        "tlab AS (SELECT database_id, table_name, k, t, table_ordinal,"
        " CASE WHEN (k + t) % 4 = 0 THEN NULL WHEN (k + t) % 4 = 1 THEN '  '"
        f" WHEN (k + t) % 3 = 0 THEN 'Rows of ' || table_name || ' kept by the tenant' || '{T.LONG_TABLE_TEXT}'"
        " ELSE 'Rows of ' || table_name || ' kept by the tenant' END AS description,"
        f" CASE WHEN (k + t) % 6 = 5 THEN NULL ELSE {ROLE_CASE} END AS business_role,"
        " CASE WHEN (k + t) % 5 = 4 THEN NULL WHEN t % 2 = 0 THEN segment ELSE 'Reference Data' END AS domain"
        " FROM tabs WHERE t < 14)",
        ("tabs",),
    ),
    "etabs": (
        "etabs AS (SELECT tabs.database_id, tabs.k, tabs.t, tabs.table_ordinal, tabs.table_name,"
        " tlab.description, tlab.business_role, tlab.domain"
        " FROM tabs LEFT JOIN tlab USING (database_id, t))",
        ("tabs", "tlab"),
    ),
    "ecols": (
        "ecols AS (SELECT *, CASE WHEN (k + g) % 4 = 0 THEN NULL WHEN (k + g) % 4 = 1 THEN ''"
        f" WHEN (k + g) % 3 = 0 THEN column_name || ' of ' || table_name || '{T.LONG_COLUMN_TEXT}'"
        " ELSE column_name || ' of ' || table_name END AS description,"
        f" coalesce({rule_case('column_name', 'label', ALL_RULES)},"
        " CASE (k + g) % 3 WHEN 1 THEN 'ID' WHEN 2 THEN 'NAME' END) AS semantic_type FROM cols)",
        ("cols",),
    ),
    "base_pairs": (values("base_pairs", "o, entity, related_entities, meaning", [(i, *p) for i, p in enumerate(T.PAIRS)]), ()),
    "pairs": (
        "pairs AS (SELECT database_id, k, CAST(o AS BIGINT) AS ordinal, entity, related_entities,"
        " CASE WHEN o = 2 AND k % 3 = 0 THEN '' ELSE meaning END AS business_meaning"
        " FROM dbs CROSS JOIN base_pairs WHERE has_tables AND (o <> 1 OR k % 5 <> 2))",
        ("dbs", "base_pairs"),
    ),
    "base_ents": (values("base_ents", "o, name", list(enumerate(T.ENTITIES))), ()),
    "ents": (
        "ents AS (SELECT database_id, k, CAST(o AS BIGINT) AS ordinal, base_ents.name AS name"
        " FROM dbs CROSS JOIN base_ents WHERE has_tables)",
        ("dbs", "base_ents"),
    ),
    "base_cases": (values("base_cases", "o, name, description, involved_tables", [(i, *p) for i, p in enumerate(T.CASES)]), ()),
    "cases": (
        "cases AS (SELECT database_id, CAST(o AS BIGINT) AS ordinal, base_cases.name AS name, description, involved_tables"
        " FROM dbs CROSS JOIN base_cases WHERE has_tables)",
        ("dbs", "base_cases"),
    ),
    "base_samples": (values("base_samples", "o, question, sql, category", [(i, *p) for i, p in enumerate(T.SAMPLES)]), ()),
    "samples": (
        "samples AS (SELECT database_id, CAST(o AS BIGINT) AS ordinal, question, sql, category"
        " FROM dbs CROSS JOIN base_samples WHERE has_tables)",
        ("dbs", "base_samples"),
    ),
}


def with_parts(*names: str, more: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """WITH clause holding the named relations and what they need, in order."""
    known = {**PARTS, **(more or {})}
    done: list[str] = []

    def need(name: str) -> None:
        for dep in known[name][1]:
            need(dep)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(known[n][0] for n in done) + "\n"
