"""SQL twins of the registered queries."""

from __future__ import annotations

from skemata.functions.rules import PATTERNS, SEMANTIC_RULES
from skemata.functions.names import IRREGULAR, PREPOSITIONS, SUPERIORS
from skemata.operators.quality import ADVICE, NO_ADVICE
from skemata.plans.sqltenants import ALL_RULES, SNAKE, lit, rule_case, values, with_parts

SQL: dict[str, str] = {}
NONE = "CAST(NULL AS VARCHAR)"

# ---------------------------------------------------------------- B: canonical

SQL["canonical_columns"] = with_parts("cols") + (
    "SELECT database_id, column_ordinal, table_ordinal, table_name, position, column_name,"
    " data_type, is_nullable, is_primary_key FROM cols"
)
SQL["canonical_relationships"] = with_parts("rels") + (
    "SELECT database_id, from_table, from_column, to_table, to_column, constraint_name FROM rels"
)
SQL["canonical_tables"] = with_parts("tabs") + (
    "SELECT database_id, table_ordinal, table_name, 'TABLE' AS table_type FROM tabs"
)
VIEW_COLUMNS = (
    "vcols AS (SELECT * FROM (VALUES ('v_orders', 0, 'o_orderkey', 'bigint', FALSE),"
    " ('v_orders', 1, 'c_name', 'unknown', TRUE), ('v_parts', 0, 'p_name', 'text', TRUE))"
    " v(view_name, position, column_name, data_type, is_nullable))"
)
SQL["canonical_views"] = with_parts("vws") + f", {VIEW_COLUMNS} " + (
    "SELECT database_id, view_ordinal, view_name, definition, CAST(position AS BIGINT) AS position,"
    " column_name, data_type, is_nullable FROM vws JOIN vcols USING (view_name)"
)
SQL["database_versions"] = with_parts("dbs") + "SELECT database_id, vendor, name, version FROM dbs"
ENDS = ["from_table", "from_column", "to_table", "to_column"]
SQL["relationship_keys"] = with_parts("rels") + (
    "SELECT database_id, rel_ordinal, " + ", ".join(ENDS) + ", 'truthy' AS mode FROM rels"
    " UNION ALL SELECT database_id, rel_ordinal, "
    + ", ".join(f"CASE WHEN k % 4 = 1 THEN '' ELSE {e} END" for e in ENDS)
    + ", 'present' FROM rels"
)
SQL["arrow_relationships"] = with_parts("rels") + (
    "SELECT database_id, rel_ordinal, from_table || '.' || from_column || ' → ' || to_table || '.'"
    " || to_column AS description, from_table AS child_table, from_column AS child_column,"
    " to_table AS parent_table, to_column AS parent_column FROM rels WHERE f % 3 <> 0"
)
SQL["document_kinds"] = with_parts("dbs") + (
    "SELECT database_id, k % 3 = 0 AND has_tables AND vendor = '' AS enriched FROM dbs"
)
CONSTRAINTS = (
    "cons AS (SELECT database_id, table_name, table_name || '_pkey' AS constraint_name,"
    " 'PRIMARY KEY' AS constraint_type, column_name FROM cols WHERE is_primary_key UNION ALL"
    " SELECT database_id, from_table, constraint_name, 'FOREIGN KEY', from_column FROM rels)"
)
IS_FK = (
    "EXISTS (SELECT 1 FROM rels r WHERE r.database_id = cols.database_id"
    " AND r.from_table = cols.table_name AND r.from_column = cols.column_name)"
)
SQL["schema_flags"] = with_parts("cols", "rels") + (
    f"SELECT database_id, table_name, column_name, is_primary_key, {IS_FK} AS is_foreign_key,"
    f" 'raw' AS source FROM cols UNION ALL SELECT database_id, table_name, column_name,"
    f" is_primary_key, {IS_FK}, 'enriched' FROM cols"
)
SQL["rebuilt_constraints"] = with_parts("cols", "rels") + (
    "SELECT database_id, table_name, column_name, 'pk_' || table_name || '_' || column_name AS"
    " constraint_name, 'PRIMARY KEY' AS constraint_type FROM cols WHERE is_primary_key UNION ALL"
    " SELECT database_id, table_name, column_name, 'fk_' || table_name || '_' || column_name,"
    f" 'FOREIGN KEY' FROM cols WHERE {IS_FK} UNION ALL"
    " SELECT database_id, from_table, from_column, coalesce(nullif(constraint_name, ''),"
    " 'fk_' || from_table || '_' || from_column), 'RELATIONSHIP' FROM rels"
)
SQL["inbound_references"] = with_parts("rels") + (
    "SELECT database_id, to_table AS table_name, from_table AS child_table,"
    " from_column AS child_column, to_column AS parent_column FROM rels"
)

# ------------------------------------------------------------------- C: rules

SQL["rule_classify_columns"] = with_parts("cols") + (
    "SELECT database_id, table_name, column_name,"
    f" {rule_case('column_name', 'label', ALL_RULES)} AS classification,"
    f" CAST({rule_case('column_name', 'confidence', ALL_RULES)} AS DOUBLE) AS confidence FROM cols"
)
SQL["semantic_classify_columns"] = with_parts("cols") + (
    "SELECT database_id, table_name, column_name,"
    f" {rule_case('column_name', 'label', SEMANTIC_RULES)} AS classification,"
    f" CAST({rule_case('column_name', 'confidence', SEMANTIC_RULES)} AS DOUBLE) AS confidence FROM cols"
)
SQL["merged_semantic_types"] = with_parts("ecols") + (
    "SELECT database_id, table_name, column_name, semantic_type,"
    f" CASE WHEN ({rule_case('column_name', 'label', ALL_RULES)}) IS NOT NULL THEN 'rule'"
    " ELSE 'model' END AS source FROM ecols WHERE semantic_type IS NOT NULL"
)
INDICATORS = values(
    "inds", "pattern, description, indicator",
    [(p.name, p.description, i.lower()) for p in PATTERNS for i in p.indicators],
)
SQL["schema_patterns"] = with_parts("cols") + f", {INDICATORS} " + (
    'SELECT database_id, pattern, table_name AS "table",'
    " string_agg(column_name, ', ' ORDER BY column_ordinal) AS evidence, description"
    " FROM cols JOIN inds ON lower(column_name) = indicator GROUP BY ALL"
)

# ------------------------------------------------------------------- D: batches

TABLE_LINES = (
    "tlines AS (SELECT tabs.database_id, table_ordinal, '  - ' || tabs.table_name || ': [' ||"
    " coalesce(l.listed, '') || ']' AS line FROM tabs LEFT JOIN (SELECT database_id, t,"
    " string_agg(column_name || ' (' || data_type || ')' || CASE WHEN is_primary_key THEN ' PK'"
    " ELSE '' END, ', ' ORDER BY column_ordinal) AS listed FROM cols GROUP BY ALL) l"
    " ON l.database_id = tabs.database_id AND l.t = tabs.t)"
)
SQL["table_listing"] = with_parts("tabs", "cols") + f", {TABLE_LINES} " + (
    "SELECT dbs.database_id, CAST(0 AS BIGINT) AS part_no, coalesce(x.text, '(no tables)') AS text"
    " FROM dbs LEFT JOIN (SELECT database_id, string_agg(line, chr(10) ORDER BY table_ordinal) AS text"
    " FROM tlines GROUP BY ALL) x USING (database_id)"
)
SQL["column_batches"] = with_parts("tabs", "cols") + f", {TABLE_LINES} " + (
    "SELECT database_id, table_ordinal // 10 AS batch_no, count(*) AS tables_count,"
    " string_agg(line, chr(10) ORDER BY table_ordinal) AS text FROM tlines GROUP BY ALL"
)
SQL["relationship_listing"] = with_parts("rels") + (
    "SELECT dbs.database_id, CAST(0 AS BIGINT) AS part_no, coalesce(x.text, '(no relationships)') AS text,"
    " 'Database: ' || name || ' | ' || coalesce(nullif(vendor, ''), '(unknown)') ||"
    " coalesce(' | Version: ' || version, '') AS context"
    " FROM dbs LEFT JOIN (SELECT database_id, string_agg('  - ' || from_table || '.' || from_column"
    " || ' → ' || to_table || '.' || to_column, chr(10) ORDER BY f) AS text FROM rels GROUP BY ALL) x"
    " USING (database_id)"
)
SQL["answer_json"] = with_parts("dbs") + (
    "SELECT database_id, 1 AS pass_no, CAST(0 AS BIGINT) AS batch_no, k % 29 <> 7 AS parsed FROM dbs WHERE has_tables"
    " UNION ALL SELECT database_id, 2, b, TRUE FROM dbs CROSS JOIN (VALUES (0), (1)) v(b) WHERE has_tables"
    " UNION ALL SELECT database_id, 3, 0, TRUE FROM dbs WHERE has_tables"
)
SQL["answer_table_labels"] = with_parts("etabs") + (
    "SELECT database_id, table_name, CASE WHEN k % 29 <> 7 THEN description END AS description,"
    " CASE WHEN k % 29 <> 7 THEN business_role END AS business_role,"
    " CASE WHEN k % 29 <> 7 THEN domain END AS domain FROM etabs"
)
SQL["answer_column_labels"] = with_parts("ecols") + (
    "SELECT database_id, table_name, column_name, description,"
    " CASE (k + g) % 3 WHEN 1 THEN 'ID' WHEN 2 THEN 'NAME' END AS semantic_type FROM ecols"
    " WHERE (k + g) % 4 <> 0 OR (k + g) % 3 <> 0"
)
SQL["answer_entities"] = with_parts("ents") + "SELECT database_id, name, ordinal FROM ents"
SQL["answer_sections"] = with_parts("pairs", "cases", "samples") + (
    "SELECT database_id, 'entity_relationships' AS section, row_number() OVER (PARTITION BY database_id ORDER BY ordinal) - 1 AS ordinal,"
    " entity || '|' || related_entities || '|' || business_meaning AS item FROM pairs UNION ALL"
    " SELECT database_id, 'use_cases', ordinal, name || '|' || description || '|' || involved_tables FROM cases UNION ALL"
    " SELECT database_id, 'sample_queries', ordinal, question || '|' || sql || '|' || category FROM samples"
)
SQL["physical_relationships"] = with_parts("rels") + (
    "SELECT database_id, rel_ordinal, from_table, to_table, from_column, to_column FROM rels"
)
SQL["section_sizes"] = with_parts("dbs") + (
    "SELECT database_id, CASE WHEN has_tables THEN 8 ELSE 0 END AS entities,"
    " CASE WHEN has_tables THEN 5 - CAST(k % 5 = 2 AS INT) ELSE 0 END AS entity_relationships,"
    " CASE WHEN has_tables THEN 2 ELSE 0 END AS use_cases,"
    " CASE WHEN has_tables THEN 2 ELSE 0 END AS sample_queries FROM dbs"
)

# ------------------------------------------------------------------ E: assembly

COUNTS = (
    "counts AS (SELECT database_id, (SELECT count(*) FROM tabs x WHERE x.database_id = dbs.database_id) AS tables_count,"
    " (SELECT count(*) FROM cols x WHERE x.database_id = dbs.database_id) AS columns_count,"
    " (SELECT count(*) FROM vws x WHERE x.database_id = dbs.database_id) AS views_count,"
    " (SELECT count(*) FROM rels x WHERE x.database_id = dbs.database_id) AS relationships_count FROM dbs)"
)
SQL["catalog_counts"] = with_parts("tabs", "cols", "vws", "rels") + f", {COUNTS} SELECT * FROM counts"
SQL["enriched_tables"] = with_parts("etabs") + (
    "SELECT database_id, table_name, table_ordinal, description, business_role, domain FROM etabs"
)
SQL["enriched_columns"] = with_parts("ecols") + (
    "SELECT database_id, table_name, column_name, column_ordinal, table_ordinal, position, data_type,"
    " is_nullable, is_primary_key, description, semantic_type FROM ecols"
)
SQL["view_sections"] = with_parts("vws") + f", {VIEW_COLUMNS} " + (
    "SELECT database_id, view_name, CAST(position AS BIGINT) AS position, column_name, data_type,"
    " is_nullable FROM vws JOIN vcols USING (view_name)"
)


def singular(x: str) -> str:
    irregular = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in IRREGULAR.items())
    return (
        f"CASE WHEN lower({x}) IN ({', '.join(lit(a) for a in IRREGULAR)}) THEN CASE lower({x}) {irregular} END"
        f" WHEN lower({x}) LIKE '%ies' AND length({x}) > 3 THEN {x}[:-4] || 'y'"
        f" WHEN regexp_matches(lower({x}), '(ss|sh|ch|s)es$') THEN {x}[:-3]"
        f" WHEN lower({x}) LIKE '%s' AND lower({x}) NOT LIKE '%ss' THEN {x}[:-2] ELSE {x} END"
    )


def compact(x: str) -> str:
    return f"replace(replace(replace(lower({x}), '_', ''), '-', ''), ' ', '')"


def short(sentence: str, entity: str | None = None) -> str:
    plain = f"regexp_replace({sentence}, '^(each|a|an)\\s+\\w+\\s+', '', 'i')"
    if entity:
        named = f"regexp_replace({sentence}, '^(each|a|an)\\s+' || {compact(entity)} || '\\s+', '', 'i')"
        body = f"CASE WHEN {named} = {sentence} THEN {plain} ELSE {named} END"
    else:
        body = plain
    for pattern, flags in (
        (r"^(\w+\s+)*?(is|are)\s+", "i"),
        (r"\s*\([^)]*\)", "g"),
        (r"\s+(and|or)\s+.*$", "s"),
        (r",.*$", "s"),
        (r";.*$", "s"),
        (r"\s+via\s+\w+(\s+to\s+\w+(\s+\w+)?)?$", ""),
        (r"\s+(a|an|one|exactly\s+one|another)\s+\w+$", "i"),
        (r"^(is|are)\s+", ""),
    ):
        tail = f", '{flags}'" if flags else ""
        body = f"regexp_replace({body}, '{pattern}', ''{tail})"
    preps = ", ".join(lit(p) for p in PREPOSITIONS)
    words = f"list_filter(string_split_regex({body}, '\\s+'), lambda w: w <> '')"
    return (
        f"(SELECT array_to_string(ws[1:greatest(1, coalesce(list_max(list_transform(ws, lambda w, i:"
        f" CASE WHEN lower(w) IN ({preps}) THEN i ELSE 1 END)), 1))], ' ') FROM (SELECT {words} AS ws))"
    )


CHILD, PARENT = singular("from_table"), singular("to_table")
NAMED = f"""
look AS (SELECT database_id, {compact('trim(entity)')} AS ce, {compact('trim(r)')} AS pe,
    arg_max(business_meaning, ordinal * 1000 + n) AS meaning, arg_max(trim(entity), ordinal * 1000 + n) AS entity
  FROM (SELECT *, unnest(string_split(related_entities, ',')) AS r, unnest(range(len(string_split(related_entities, ',')))) AS n FROM pairs)
  WHERE trim(entity) <> '' AND business_meaning <> '' AND trim(r) <> '' GROUP BY 1, 2, 3),
sing AS (SELECT *, {CHILD} AS child1, {PARENT} AS parent1 FROM rels),
made AS (SELECT *, CASE
    WHEN contains(lower(from_column), lower(parent1)) THEN 'each ' || child1 ||
      CASE WHEN lower(parent1) IN ({', '.join(lit(x) for x in SUPERIORS)}) THEN ' reports to a ' ELSE ' belongs to a ' END || parent1
    WHEN from_table = to_table AND from_column <> to_column THEN 'each ' || child1 || ' references another ' || child1 || ' via ' || from_column
    WHEN lower(from_column) IN ('id', from_table || '_id') THEN 'each ' || child1 || ' is associated with one ' || parent1
    ELSE 'each ' || child1 || ' references ' || parent1 || ' via ' || from_column END AS sentence FROM sing),
found AS (SELECT made.*, coalesce(a.meaning, b.meaning) AS meaning, CASE WHEN a.meaning IS NOT NULL THEN a.entity ELSE b.entity END AS entity
  FROM made LEFT JOIN look a ON a.database_id = made.database_id AND a.ce = {compact('child1')} AND a.pe = {compact('parent1')}
  LEFT JOIN look b ON b.database_id = made.database_id AND b.ce = {compact('parent1')} AND b.pe = {compact('child1')}),
texts AS (SELECT DISTINCT sentence, meaning, entity FROM found),
phrases AS (SELECT *, CASE WHEN meaning IS NOT NULL THEN {short('meaning', 'entity')} ELSE {short('sentence')} END AS name FROM texts),
named AS (SELECT found.*, phrases.name AS name, coalesce(found.meaning, found.sentence) AS description FROM found JOIN phrases
  ON found.sentence IS NOT DISTINCT FROM phrases.sentence AND found.meaning IS NOT DISTINCT FROM phrases.meaning AND found.entity IS NOT DISTINCT FROM phrases.entity)
"""
SQL["relationship_names"] = with_parts("rels", "pairs") + f", {NAMED} " + (
    "SELECT database_id, from_table, from_column, to_table, to_column, name, description,"
    " from_table AS child_table, from_column AS child_column, to_table AS parent_table,"
    " to_column AS parent_column FROM named"
)
SQL["business_processes"] = with_parts("etabs") + (
    "SELECT database_id, domain, table_ordinal, table_name, min(table_ordinal) OVER (PARTITION BY database_id, domain) AS first_seen"
    " FROM etabs WHERE domain IS NOT NULL"
)

# ---------------------------------------------------------------- F: validation

ISSUES = f"""issues AS (
SELECT database_id, 'WARN' AS severity, 'no_schema' AS type, {NONE} AS table_name, {NONE} AS column_name,
  'canonical_schema is None — no schema to validate' AS message
FROM dbs WHERE NOT EXISTS (SELECT 1 FROM tabs WHERE tabs.database_id = dbs.database_id)
UNION ALL
SELECT database_id, 'WARN', 'missing_pk', table_name, NULL,
  'Table ''' || table_name || ''' has no primary key column. Consider adding a PRIMARY KEY constraint.'
FROM tabs WHERE NOT EXISTS (SELECT 1 FROM cols WHERE cols.database_id = tabs.database_id AND cols.t = tabs.t AND is_primary_key)
UNION ALL
SELECT database_id, 'WARN', 'broken_fk', from_table, from_column,
  'Foreign key ' || from_table || '.' || from_column || ' references table ''' || to_table || ''', which does not exist in the schema.'
FROM rels WHERE NOT EXISTS (SELECT 1 FROM tabs WHERE tabs.database_id = rels.database_id AND tabs.table_name = rels.to_table)
UNION ALL
SELECT database_id, 'WARN', 'empty_table', table_name, NULL, 'Table ''' || table_name || ''' has no columns defined.'
FROM tabs WHERE NOT EXISTS (SELECT 1 FROM cols WHERE cols.database_id = tabs.database_id AND cols.t = tabs.t)
UNION ALL
SELECT database_id, 'INFO', 'missing_description', table_name, NULL, 'Table ''' || table_name || ''' has no business description.'
FROM etabs WHERE description IS NULL
UNION ALL
SELECT database_id, 'INFO', 'missing_description', table_name, column_name, 'Column ''' || table_name || '.' || column_name || ''' has no business description.'
FROM ecols WHERE description IS NULL
UNION ALL
SELECT database_id, 'INFO', 'missing_semantic_type', table_name, column_name, 'Column ''' || table_name || '.' || column_name || ''' has no semantic type label.'
FROM ecols WHERE semantic_type IS NULL)"""
WITH_ISSUES = with_parts("tabs", "cols", "rels", "etabs", "ecols") + f", {ISSUES} "
SQL["validation_issues"] = WITH_ISSUES + "SELECT * FROM issues"
SQL["validation_status"] = WITH_ISSUES + (
    "SELECT dbs.database_id, CASE WHEN coalesce(bool_or(severity = 'WARN'), FALSE) THEN 'WARN' ELSE 'PASS' END AS status,"
    " count(severity) AS issues_count FROM dbs LEFT JOIN issues USING (database_id) GROUP BY 1"
)
SQL["issue_section"] = WITH_ISSUES + (
    "SELECT database_id, severity, type, count(*) AS n, count(*) - count(column_name) AS without_column"
    " FROM issues GROUP BY ALL"
)


def orphans(child: str, key: str, parent: str, pkey: str) -> str:
    return (
        f"SELECT '{child}.{key}' AS foreign_key, count(*) AS orphan_rows, count(DISTINCT {key}) AS orphan_keys,"
        f" min(CAST({key} AS VARCHAR)) AS sample_key FROM {child} WHERE {key} IS NOT NULL"
        f" AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {pkey} = {child}.{key})"
    )


STAR = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "documents.doc_id"),
    ("events", "user_id", "supplier", "s_suppkey"),
    ("conversations", "conv_id", "benchmark", "item_id"),
]
SQL["orphan_fk_rows"] = " UNION ALL ".join(orphans(*s) for s in STAR)
SQL["pk_violations"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS key,"
    f" count(*) AS rows_count, {' OR '.join(f'{c} IS NULL' for c in cols)} AS has_null FROM {t}"
    f" GROUP BY {', '.join(cols)} HAVING count(*) > 1 OR {' OR '.join(f'{c} IS NULL' for c in cols)}"
    for t, cols in (
        ("lineitem", ["l_orderkey", "l_linenumber"]), ("labels", ["doc_id"]),
        ("orders", ["o_orderkey"]), ("events", ["user_id"]),
    )
)

# ------------------------------------------------------------------- G: quality

FK_NAME = "'^[a-z][a-z0-9]*(_[a-z0-9]+)+_fkey$'"
OK = "(trim(coalesce({0}, '')) <> '')"


def ok(c: str) -> str:
    return OK.format(c)


CANDIDATES = """cand AS (
  SELECT database_id, k, 0 AS kind, table_ordinal AS place, table_name, CAST(NULL AS VARCHAR) AS column_name FROM QT WHERE trim(coalesce(description, '')) <> '' AND length(trim(description)) < 80
  UNION ALL SELECT database_id, k, 1, column_ordinal, table_name, column_name FROM QC WHERE trim(coalesce(description, '')) <> '' AND length(trim(description)) < 60),
judged AS (SELECT * FROM cand WHERE (k + place) % 3 = 0)"""


def scores(tabs: str, cols: str, name_col: str, judged: bool) -> str:
    bad_t = "(SELECT count(*) FROM judged j WHERE j.database_id = dbs.database_id AND kind = 0)" if judged else "0"
    bad_c = "(SELECT count(*) FROM judged j WHERE j.database_id = dbs.database_id AND kind = 1)" if judged else "0"
    return f"""
per_table AS (SELECT q.database_id, q.t, any_value(q.business_role) AS business_role, count(c.g) AS n, count(*) FILTER (c.is_primary_key) AS keys
  FROM {tabs} q LEFT JOIN {cols} c ON c.database_id = q.database_id AND c.t = q.t GROUP BY 1, 2),
mt AS (SELECT database_id, count(*)::DOUBLE AS t, count(*) FILTER ({ok('description')} AND {ok('business_role')} AND {ok('domain')})::DOUBLE AS t_ok,
  count(*) FILTER ({ok('description')})::DOUBLE AS t_texts, sum(length(trim(coalesce(description, ''))))::DOUBLE AS t_length,
  count(*) FILTER (regexp_matches(table_name, {SNAKE}))::DOUBLE AS t_snake FROM {tabs} GROUP BY 1),
mc AS (SELECT database_id, count(*)::DOUBLE AS c, count(*) FILTER ({ok('description')} AND {ok('semantic_type')})::DOUBLE AS c_ok,
  count(*) FILTER ({ok('description')})::DOUBLE AS c_texts, sum(length(trim(coalesce(description, ''))))::DOUBLE AS c_length,
  count(*) FILTER (regexp_matches(column_name, {SNAKE}))::DOUBLE AS c_snake FROM {cols} GROUP BY 1),
mp AS (SELECT database_id, count(*) FILTER (n > 20)::DOUBLE AS wide, count(*) FILTER (keys = 0)::DOUBLE AS keyless,
  count(*) FILTER (business_role = 'junction' AND keys < 2)::DOUBLE AS junctions FROM per_table GROUP BY 1),
mr AS (SELECT database_id, count(*)::DOUBLE AS repeated FROM (SELECT database_id, column_name FROM {cols} GROUP BY 1, 2 HAVING count(*) > 5) GROUP BY 1),
mf AS (SELECT database_id, count(*)::DOUBLE AS fk, count(*) FILTER (regexp_matches(coalesce({name_col}, ''), {FK_NAME}))::DOUBLE AS fk_named FROM named GROUP BY 1),
me AS (SELECT database_id, avg(CASE WHEN trim(business_meaning) <> '' THEN 1.0 ELSE 0.0 END)::DOUBLE AS er FROM pairs GROUP BY 1),
m AS (SELECT dbs.database_id, coalesce(t, 0) t, coalesce(t_ok, 0) t_ok, coalesce(t_texts, 0) t_texts, coalesce(t_length, 0) t_length, coalesce(t_snake, 0) t_snake,
  coalesce(c, 0) c, coalesce(c_ok, 0) c_ok, coalesce(c_texts, 0) c_texts, coalesce(c_length, 0) c_length, coalesce(c_snake, 0) c_snake,
  coalesce(wide, 0) wide, coalesce(keyless, 0) keyless, coalesce(junctions, 0) junctions, coalesce(repeated, 0) repeated,
  coalesce(fk, 0) fk, coalesce(fk_named, 0) fk_named, coalesce(er, 1.0) er, {bad_t}::DOUBLE AS t_bad, {bad_c}::DOUBLE AS c_bad
  FROM dbs LEFT JOIN mt USING (database_id) LEFT JOIN mc USING (database_id) LEFT JOIN mp USING (database_id)
  LEFT JOIN mr USING (database_id) LEFT JOIN mf USING (database_id) LEFT JOIN me USING (database_id)),
raw AS (SELECT database_id,
  CASE WHEN t > 0 THEN 0.4::DOUBLE * (t_ok / greatest(t, 1)) + 0.6::DOUBLE * (c_ok / greatest(c, 1)) ELSE 0 END AS completeness,
  CASE WHEN t > 0 AND fk > 0 THEN 0.5::DOUBLE * least(fk / greatest(t, 1) / 2.0::DOUBLE, 1) + 0.5::DOUBLE * (fk_named / greatest(fk, 1)) ELSE 0 END AS relationships,
  CASE WHEN t > 0 THEN (t_snake + c_snake) / greatest(t + c, 1) ELSE 0 END AS naming_convention,
  CASE WHEN t > 0 THEN 0.3::DOUBLE * (least(t_length / greatest(t_texts, 1) / 100.0::DOUBLE, 1) * (1 - 0.3::DOUBLE * (t_bad / greatest(t, 1))))
    + 0.4::DOUBLE * (least(c_length / greatest(c_texts, 1) / 60.0::DOUBLE, 1) * (1 - 0.3::DOUBLE * (c_bad / greatest(c, 1)))) + 0.3::DOUBLE * er ELSE 0 END AS documentation,
  CASE WHEN t > 0 THEN greatest(1 - (0.1::DOUBLE * repeated + 0.2::DOUBLE * wide + 0.3::DOUBLE * keyless + 0.2::DOUBLE * junctions), 0) ELSE 0 END AS normalization FROM m),
scored AS (SELECT database_id, round_even(completeness * 0.25::DOUBLE + relationships * 0.20::DOUBLE + naming_convention * 0.15::DOUBLE
  + documentation * 0.25::DOUBLE + normalization * 0.15::DOUBLE, 4) AS overall_score, round_even(completeness, 4) AS completeness,
  round_even(relationships, 4) AS relationships, round_even(naming_convention, 4) AS naming_convention,
  round_even(documentation, 4) AS documentation, round_even(normalization, 4) AS normalization FROM raw)"""


WITH_QUALITY = with_parts("etabs", "ecols", "rels", "pairs") + f", {NAMED}, "
PLAIN = WITH_QUALITY + scores("etabs", "ecols", "name", False)
SQL["quality_scores"] = PLAIN + " SELECT * FROM scored"
SQL["quality_scores_judged"] = (
    WITH_QUALITY
    + CANDIDATES.replace("QT", "etabs").replace("QC", "ecols")
    + ", "
    + scores("etabs", "ecols", "constraint_name", True)
    + " SELECT * FROM scored"
)
SQL["quality_of_domain"] = (
    WITH_QUALITY
    + "dtabs AS (SELECT * FROM etabs WHERE domain = 'Reference Data'), dcols AS (SELECT ecols.* FROM ecols"
    " SEMI JOIN dtabs USING (database_id, t)), "
    + scores("dtabs", "dcols", "name", False)
    + " SELECT * FROM scored"
)
DIMENSIONS = ["completeness", "relationships", "naming_convention", "documentation", "normalization"]
SQL["score_display"] = PLAIN + " SELECT database_id, " + ", ".join(
    f"CAST(CAST(trunc({c} * 100) AS INT) AS VARCHAR) || '/100' AS {c}" for c in ["overall_score", *DIMENSIONS]
) + " FROM scored"
SQL["recommendations"] = PLAIN + (
    ", advice AS (SELECT database_id, list_filter(["
    + ", ".join(f"CASE WHEN {d} < 0.7 THEN {lit(ADVICE[d])} END" for d in DIMENSIONS)
    + "], lambda x: x IS NOT NULL) AS a FROM scored),"
    f" full_advice AS (SELECT database_id, CASE WHEN len(a) > 0 THEN a ELSE [{lit(NO_ADVICE)}] END AS a FROM advice)"
    " SELECT database_id, unnest(range(len(a)))::INT AS ordinal, unnest(a) AS recommendation FROM full_advice"
)


def gap(rel: str, when: str, severity: str, kind: str, message: str, group: int, place: str, nth: int, table="table_name", column="NULL") -> str:
    return (
        f"SELECT database_id, '{severity}' AS severity, '{kind}' AS type, {table} AS table_name, CAST({column} AS VARCHAR) AS column_name,"
        f" {message} AS message, {group} AS group_no, {place} AS place, {nth} AS nth FROM {rel} WHERE {when}"
    )


T_ = "'Table ''' || table_name || '''"
C_ = "'Column ''' || table_name || '.' || column_name || '''"
TP, CP = "table_ordinal * 2147483648", "table_ordinal * 2147483648 + 1 + position"


def quality_issues(judged: bool) -> str:
    parts = [
        gap("etabs", f"NOT {ok('description')}", "WARN", "missing_table_description", f"{T_} has no business description.'", 1, TP, 0),
        gap("etabs", f"NOT {ok('business_role')}", "WARN", "missing_business_role", f"{T_} has no business_role assigned.'", 1, TP, 1),
        gap("etabs", f"NOT {ok('domain')}", "WARN", "missing_domain", f"{T_} has no domain assigned.'", 1, TP, 2),
        gap("ecols", f"NOT {ok('description')}", "INFO", "missing_column_description", f"{C_} has no description.'", 1, CP, 0, column="column_name"),
        gap("ecols", f"NOT {ok('semantic_type')}", "INFO", "missing_semantic_type", f"{C_} has no semantic_type.'", 1, CP, 1, column="column_name"),
        gap("rels", f"NOT regexp_matches(coalesce(constraint_name, ''), {FK_NAME})", "WARN", "nonstandard_fk_name",
            "'FK ''' || coalesce(constraint_name, '') || ''' does not follow the {child_table}_{child_column}_fkey naming convention.'", 2, "rel_ordinal", 0,
            table="nullif(regexp_extract(coalesce(constraint_name, ''), '^(.*)_[^_]*_[^_]*$', 1), '')"),
        gap("etabs", f"NOT regexp_matches(table_name, {SNAKE})", "WARN", "non_snake_case",
            "'Table name ''' || table_name || ''' does not follow snake_case convention.'", 3, TP, 0),
        gap("ecols", f"NOT regexp_matches(column_name, {SNAKE})", "WARN", "non_snake_case",
            "'Column name ''' || table_name || '.' || column_name || ''' does not follow snake_case convention.'", 3, CP, 0, column="column_name"),
        gap("(SELECT database_id, column_name, count(*) AS n, array_to_string((list(table_name ORDER BY g))[1:5], ', ') AS sample, min(g) AS g FROM ecols GROUP BY 1, 2)",
            "n > 5", "INFO", "redundant_column",
            "'Column ''' || column_name || ''' appears in ' || n || ' tables (' || sample || ', ...). This may indicate a missing normalization or shared lookup table.'",
            5, "g", 0, table="CAST(NULL AS VARCHAR)", column="column_name"),
        gap("sized", "n > 20", "WARN", "wide_table", f"{T_} has ' || n || ' columns (>20). Consider vertical partitioning or normalization.'", 6, "table_ordinal", 0),
        gap("sized", "keys = 0", "WARN", "missing_pk", f"{T_} has no primary key column.'", 7, "table_ordinal", 0),
        gap("sized", "business_role = 'junction' AND keys < 2", "WARN", "junction_missing_composite_pk",
            "'Junction table ''' || table_name || ''' has fewer than 2 primary key columns. Junction tables should have a composite PK on the FK columns.'", 8, "table_ordinal", 0),
    ]
    if judged:
        parts += [
            gap("judged", "kind = 0", "WARN", "boilerplate_table_description", f"{T_} description may be boilerplate: generic wording'", 4, "place", 0),
            gap("judged", "kind = 1", "INFO", "boilerplate_column_description", f"{C_} description may be boilerplate: generic wording'", 4, "place", 0, column="column_name"),
        ]
    return (
        "sized AS (SELECT q.database_id, q.table_name, q.table_ordinal, q.business_role, count(c.g) AS n, count(*) FILTER (c.is_primary_key) AS keys"
        " FROM etabs q LEFT JOIN ecols c ON c.database_id = q.database_id AND c.t = q.t GROUP BY ALL), qissues AS ("
        + " UNION ALL ".join(parts) + ")"
    )


WITH_ROWS = with_parts("etabs", "ecols", "rels")
SQL["quality_issues"] = (
    WITH_ROWS + ", " + CANDIDATES.replace("QT", "etabs").replace("QC", "ecols") + ", " + quality_issues(True)
    + " SELECT database_id, severity, type, table_name, column_name, message FROM qissues"
)
SQL["issue_samples"] = (
    WITH_ROWS + ", " + quality_issues(False)
    + " SELECT database_id, line_no::INT AS line_no, '- [' || severity || '] ' || message AS line FROM (SELECT *, row_number() OVER"
    " (PARTITION BY database_id ORDER BY group_no, place, nth) AS line_no FROM qissues) WHERE line_no <= 5"
)
def section_md5(rows: str, order: str, *fields: str) -> str:
    """MD5 over the rows of a database in order, as the query under test writes them."""
    line = " || '|' || ".join(f"coalesce({f}, '-')" for f in fields)
    return f"md5(coalesce((SELECT string_agg({line}, ';' ORDER BY {order}) FROM {rows} x WHERE x.database_id = dbs.database_id), ''))"


SQL["assembled_documents"] = (
    with_parts("tabs", "cols", "rels", "etabs", "ecols", "vws", "ents", "pairs", "cases", "samples")
    + f", {ISSUES}, {COUNTS}, {VIEW_COLUMNS},"
    " tcols AS (SELECT database_id, t, string_agg(column_name || ':' || data_type || ':' || is_nullable, ',' ORDER BY column_ordinal) AS list"
    " FROM ecols GROUP BY ALL),"
    " wt AS (SELECT etabs.*, coalesce(list, '') AS list FROM etabs LEFT JOIN tcols USING (database_id, t)),"
    " vl AS (SELECT view_name, string_agg(column_name || ':' || data_type || ':' || is_nullable, ',' ORDER BY position) AS list FROM vcols GROUP BY ALL),"
    " wv AS (SELECT vws.*, coalesce(list, '') AS list FROM vws LEFT JOIN vl USING (view_name))"
    " SELECT dbs.database_id, dbs.name AS database_name, columns_count, "
    + section_md5("wt", "table_ordinal", "table_name", "description", "business_role", "domain", "list") + " AS tables, "
    + section_md5("wv", "view_ordinal", "view_name", "definition", "list") + " AS views, "
    + section_md5("rels", "rel_ordinal", *ENDS) + " AS relationships, "
    + section_md5("ents", "ordinal", "name") + " AS entities, "
    + section_md5("pairs", "ordinal", "entity", "related_entities", "business_meaning") + " AS pairs, "
    + section_md5("cases", "ordinal", "name", "description", "involved_tables") + " AS use_cases, "
    + section_md5("samples", "ordinal", "question", "sql", "category") + """ AS sample_queries,
 (SELECT count(DISTINCT domain) FROM etabs x WHERE x.database_id = dbs.database_id)::INT AS n_processes,
 (SELECT count(*) FROM issues x WHERE x.database_id = dbs.database_id)::INT AS n_issues
FROM dbs JOIN counts USING (database_id)"""
)

# ------------------------------------------------------------------ H: objects


def shown(c: str) -> str:
    return f"coalesce({c}, 'None')"


OBJECTS = f"""
tobj AS (SELECT q.database_id, 'table' AS object_type, q.table_name AS object_name, 'table:' || q.table_name AS object_key,
  'Table: ' || q.table_name || chr(10) || 'Description: ' || {shown('q.description')} || chr(10) || 'Business Role: ' || {shown('q.business_role')}
  || chr(10) || 'Domain: ' || {shown('q.domain')} || chr(10) || 'Columns:' || chr(10) || coalesce(l.listed, '') AS text_content,
  q.table_name AS table_name, {NONE} AS column_name, CAST(coalesce(l.n, 0) AS VARCHAR) AS column_count, {NONE} AS is_primary_key,
  {NONE} AS from_table, {NONE} AS relationship_type, {NONE} AS entity
  FROM etabs q LEFT JOIN (SELECT database_id, t, count(*) AS n, string_agg('  - ' || column_name || ' (' || data_type || ')[' || {shown('semantic_type')} || ']: '
    || {shown('description')}, chr(10) ORDER BY position) AS listed FROM ecols GROUP BY ALL) l ON l.database_id = q.database_id AND l.t = q.t),
cobj AS (SELECT database_id, 'column' AS object_type, table_name || '.' || column_name AS object_name, 'column:' || table_name || '.' || column_name AS object_key,
  'Column: ' || table_name || '.' || column_name || chr(10) || 'Data Type: ' || data_type || chr(10) || 'Semantic Type: ' || {shown('semantic_type')} || chr(10)
  || 'Description: ' || {shown('description')} || chr(10) || 'Primary Key: ' || CASE WHEN is_primary_key THEN 'True' ELSE 'False' END || chr(10)
  || 'Nullable: ' || CASE WHEN is_nullable THEN 'True' ELSE 'False' END AS text_content,
  table_name, column_name, NULL AS column_count, CASE WHEN is_primary_key THEN 'true' ELSE 'false' END AS is_primary_key, NULL AS from_table, NULL AS relationship_type, NULL AS entity FROM ecols),
robj AS (SELECT database_id, 'relationship' AS object_type, from_table || '.' || from_column || '->' || to_table || '.' || to_column AS object_name,
  'relationship:' || from_table || '.' || from_column || '->' || to_table || '.' || to_column AS object_key,
  'Foreign Key: ' || from_table || '.' || from_column || ' -> ' || to_table || '.' || to_column || chr(10) || 'Relationship Type: foreign_key' AS text_content,
  NULL AS table_name, NULL AS column_name, NULL AS column_count, NULL AS is_primary_key, from_table, 'foreign_key' AS relationship_type, NULL AS entity FROM rels),
eobj AS (SELECT database_id, 'relationship' AS object_type, entity || '->' || related_entities AS object_name, 'entity_relationship:' || entity || '->' || related_entities AS object_key,
  'Entity Relationship: ' || entity || ' -> ' || related_entities || chr(10) || 'Business Meaning: ' || business_meaning || chr(10) || 'Relationship Type: entity_relationship' AS text_content,
  NULL AS table_name, NULL AS column_name, NULL AS column_count, NULL AS is_primary_key, NULL AS from_table, 'entity_relationship' AS relationship_type, entity FROM pairs),
objects AS (SELECT * FROM tobj UNION ALL SELECT * FROM cobj UNION ALL SELECT * FROM robj UNION ALL SELECT * FROM eobj)
"""
WITH_OBJECTS = with_parts("etabs", "ecols", "rels", "pairs") + f", {OBJECTS} "
SQL["embedding_texts"] = WITH_OBJECTS + (
    "SELECT database_id, object_type, object_name, object_key, text_content FROM objects"
)
SQL["object_metadata"] = WITH_OBJECTS + (
    "SELECT database_id, object_key, table_name, column_name, column_count, is_primary_key, from_table, relationship_type, entity FROM objects"
)


def digest(text: str) -> str:
    """16 numbers of an md5 digest, scaled to unit length of 384 dimensions."""
    raw = (
        f"list_transform(range(16), lambda i: CAST(('0x' || substr(md5({text}), CAST(i * 2 + 1 AS INT), 2))::INT AS DOUBLE) / 127.5 - 1)"
    )
    return f"(SELECT list_transform(r, lambda x: x / sqrt(24 * list_sum(list_transform(r, lambda y: y * y)))) FROM (SELECT {raw} AS r))"


SQL["hash_embeddings"] = (
    f"SELECT doc_id, 384 AS dimensions, 1.0::DOUBLE AS length, round(v[1], 6) AS v0, round(v[2], 6) AS v1, round(v[16], 6) AS v15,"
    f" round(v[1], 6) AS v16, round(v[16], 6) AS v383 FROM (SELECT doc_id, {digest('text')} AS v FROM documents)"
)
SQL["model_embeddings"] = (
    "SELECT doc_id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS v1,"
    " (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS v2 FROM documents"
)
SQL["upsert_latest"] = (
    "WITH b AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id,"
    " arg_max(ts, event_id) AS ts FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1),"
    " n AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id"
    " FROM events WHERE event_type NOT IN ('view', 'signup') GROUP BY 1)"
    " SELECT user_id, coalesce(n.event_type, b.event_type) AS event_type, coalesce(n.value, b.value) AS value, coalesce(n.event_id, b.event_id) AS event_id,"
    " coalesce(b.ts, TIMESTAMP '2030-01-01') AS created_at, CASE WHEN n.user_id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE b.ts END AS updated_at"
    " FROM b FULL JOIN n USING (user_id)"
)

# ------------------------------------------------------------------- H: search

SIMS = (
    "WITH sims AS (SELECT q.vec_id AS question_id, v.vec_id AS object_key, v.label,"
    " round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s FROM embeddings q CROSS JOIN embeddings v)"
)
SQL["trained_index_recall"] = (
    "SELECT CAST(count(*) * least(10, count(*)) AS BIGINT) AS exact_pairs, TRUE AS reached FROM embeddings"
)
SQL["knn_topk"] = SIMS + (
    " SELECT question_id, object_key, round(s, 6) AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY question_id ORDER BY s DESC, object_key) AS r FROM sims) WHERE r <= 10"
)
SQL["knn_by_label"] = SIMS + (
    " SELECT question_id, label, object_key, round(s, 6) AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY question_id, label ORDER BY s DESC, object_key) AS r FROM sims)"
    " WHERE r <= CASE label WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 2 END"
)
SQL["knn_sharded"] = SIMS + (
    " SELECT question_id, object_key, round(s, 6) AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY question_id ORDER BY s DESC, object_key) AS r FROM sims) WHERE r <= 5"
)

# -------------------------------------------------------------------- I: graph

SQL["graph_vertices"] = with_parts("etabs", "ecols", "ents") + (
    "SELECT database_id, 'Table' AS kind, table_name AS name, description FROM etabs UNION ALL"
    " SELECT database_id, 'Column', table_name || '.' || column_name, description FROM ecols UNION ALL"
    " SELECT DISTINCT database_id, 'Entity', name, NULL FROM ents"
)
FK = (
    "fks AS (SELECT DISTINCT r.database_id, k, from_table, from_column, to_table, to_column FROM rels r"
    " SEMI JOIN cols a ON a.database_id = r.database_id AND a.table_name = from_table AND a.column_name = from_column"
    " SEMI JOIN cols b ON b.database_id = r.database_id AND b.table_name = to_table AND b.column_name = to_column)"
)
WITH_FK = with_parts("tabs", "cols", "rels", "ents", "pairs") + f", {FK}"
SQL["graph_edges"] = WITH_FK + (
    " SELECT DISTINCT database_id, 'HAS_COLUMN' AS kind, table_name AS start, column_name AS \"end\" FROM cols UNION ALL"
    " SELECT database_id, 'FK_TO', from_table || '.' || from_column, to_table || '.' || to_column FROM fks UNION ALL"
    " SELECT t.database_id, 'BELONGS_TO_ENTITY', table_name, arg_max(name, ordinal) FROM tabs t JOIN ents e"
    " ON e.database_id = t.database_id AND lower(e.name) = lower(table_name) GROUP BY 1, 3 UNION ALL"
    " SELECT DISTINCT p.database_id, 'RELATED_TO', entity, related_entities FROM pairs p"
    " SEMI JOIN ents a ON a.database_id = p.database_id AND a.name = entity SEMI JOIN ents b ON b.database_id = p.database_id AND b.name = related_entities"
)
SQL["split_entity_edges"] = WITH_FK + (
    ", sp AS (SELECT database_id, entity, trim(unnest(string_split(related_entities, ','))) AS related, business_meaning FROM pairs)"
    " SELECT DISTINCT p.* FROM sp p SEMI JOIN ents a ON a.database_id = p.database_id AND a.name = entity"
    " SEMI JOIN ents b ON b.database_id = p.database_id AND b.name = related"
)
SQL["key_clashes"] = with_parts("tabs", "cols") + (
    "SELECT database_id, 'Table' AS kind, table_name AS key, count(*) AS rows_count FROM tabs GROUP BY ALL HAVING count(*) > 1 UNION ALL"
    " SELECT database_id, 'Column', lower(column_name), count(*) FROM cols GROUP BY ALL HAVING count(*) > 1"
)
ADJ = (
    "adj AS (SELECT * EXCLUDE (k) FROM fks UNION ALL SELECT database_id, to_table, to_column, from_table, from_column FROM fks)"
)
SQL["adjacency"] = WITH_FK + f", {ADJ} SELECT * FROM adj"


def paths(hops: int, starts: str) -> str:
    """Recursive twin of the path search; ``starts``: database_id, i, t rows."""
    return f""", {ADJ}, starts AS ({starts}),
paths AS (WITH RECURSIVE p AS (
  SELECT a.key, a.database_id, a.i AS i, b.i AS j, b.t AS tgt, a.t AS node, [a.t] AS tables, CAST([] AS VARCHAR[]) AS steps FROM starts a JOIN starts b
    ON a.key = b.key AND a.database_id = b.database_id AND a.i < b.i
  UNION ALL
  SELECT p.key, p.database_id, p.i, p.j, p.tgt, e.to_table, list_append(p.tables, e.to_table),
    list_append(p.steps, e.from_table || '.' || e.from_column || '=' || e.to_table || '.' || e.to_column)
  FROM p JOIN adj e ON e.database_id = p.database_id AND e.from_table = p.node
  WHERE p.node <> p.tgt AND len(p.steps) < {hops} AND NOT list_contains(p.tables, e.to_table))
SELECT key, database_id, i, j, tables, steps, len(steps) AS hops FROM p WHERE node = tgt)"""


def cased(x: str) -> str:
    return f"CASE WHEN k % 7 = 0 THEN upper(substr({x}, 1, 1)) || substr({x}, 2) ELSE {x} END"


STARTS = (
    "SELECT 0 AS key, database_id, i, " + cased("t") + " AS t FROM dbs CROSS JOIN"
    " (VALUES (0, 'region'), (1, 'part'), (2, 'lineitem'), (3, 'customer')) v(i, t)"
)
SQL["join_paths"] = WITH_FK + paths(3, STARTS) + (
    " SELECT database_id, i::INT AS i, j::INT AS j, array_to_string(tables, '>') AS tables, array_to_string(steps, ';') AS steps, hops::INT AS hops FROM paths"
)
SQL["join_paths_both_ends"] = SQL["join_paths"]
SQL["path_pairs"] = WITH_FK + paths(2, STARTS) + (
    " SELECT DISTINCT database_id, tables[n] AS entity, tables[n + 1] AS related_entities FROM paths, unnest(range(1, len(tables))) u(n)"
)
SQL["neighbourhood"] = with_parts("rels") + (
    ", sel AS (SELECT database_id, " + cased("'orders'") + " AS s FROM dbs), near AS (SELECT database_id, s AS t FROM sel UNION"
    " SELECT r.database_id, to_table FROM rels r JOIN sel ON sel.database_id = r.database_id AND from_table = s UNION"
    " SELECT r.database_id, from_table FROM rels r JOIN sel ON sel.database_id = r.database_id AND to_table = s)"
    " SELECT database_id, 'node' AS kind, t AS name FROM near UNION ALL"
    " SELECT database_id, 'edge', concat_ws('-', from_table, from_column, to_table, to_column) FROM rels r"
    " SEMI JOIN near a ON a.database_id = r.database_id AND a.t = from_table SEMI JOIN near b ON b.database_id = r.database_id AND b.t = to_table"
)
SQL["diagram"] = with_parts("tabs", "rels") + (
    "SELECT database_id, concat_ws('-', from_table, from_column, to_table, to_column) AS edge_id, to_table AS source, from_table AS target,"
    " 'source-' || to_column AS source_handle, 'target-' || from_column AS target_handle FROM rels UNION ALL"
    " SELECT database_id, table_name, NULL, NULL, NULL, NULL FROM tabs"
)

# ----------------------------------------------------------------- K: SQL text


def log_cte() -> str:
    from skemata.plans.text_queries import STATEMENTS

    whens = " ".join(
        f"WHEN {i} THEN replace(replace(replace({lit(s)}, '{{id}}', event_id::VARCHAR), '{{user}}', user_id::VARCHAR), '{{value}}', floor(value)::BIGINT::VARCHAR)"
        for i, s in enumerate(STATEMENTS)
    )
    return f"log AS (SELECT user_id AS database_id, event_id AS query_id, CASE event_id % {len(STATEMENTS)} {whens} END AS sql FROM events)"


def answers_cte() -> str:
    from skemata.plans.text_queries import WRAPPINGS

    whens = " ".join(f"WHEN {i} THEN replace({lit(s)}, '{{sql}}', sql)" for i, s in enumerate(WRAPPINGS))
    return (
        f"ans AS (SELECT database_id, query_id, CASE query_id % 37 % {len(WRAPPINGS)} {whens} END AS answer,"
        " CASE WHEN query_id % 41 = 0 THEN 0 ELSE 3 END AS table_count FROM log)"
    )


# What a reader finds in each statement of the log, written out: table names after the
# five words (K1), names without those of WITH, and per statement its type, tables,
# qualified pairs, columns used, danger, and whether it is a statement at all.
DDL, BULK = "Dangerous DDL statement detected: ", " without WHERE clause — unsafe operation"
REFS = [
    (0, "customer", None), (1, "customer,orders", None), (2, "orders", None), (3, "part", None),
    (4, "lineitem", None), (5, "ghost_table,nation", None), (6, "customer", None), (7, "", None),
    (8, "part,t", "part"), (9, "nation,x,y", None), (10, "part", None), (11, "events", None),
    (12, "orders", None), (13, "supplier", None), (14, "part,supplier,table", None),
    (15, "o_orderdate,orders", None), (16, "public", None), (17, "", None), (18, "orders", None),
    (19, "orders", None), (20, "", None), (21, "", None), (22, "orders", None),
    (23, "part,supplier", None), (24, "nation", None), (25, "orders", None), (26, "orders", None),
    (27, "", None), (28, "", None), (29, "orders", None), (30, "orders", None), (31, "orders", None),
    (32, "orders", None), (33, "orders", None), (34, "orders", None), (35, "ghost,orders", None),
    (36, "ghost,orders", None), (37, "generate_series", None), (38, "orders,r", "orders"),
    (39, "orders", None), (40, "ghost", None), (41, "ghost,part", None),
]
FACTS = [
    (0, 0, "SELECT", "customer", "", "c_name|c_custkey", None, True),
    (1, 0, "SELECT", "orders|customer", "", "o_orderkey|o_custkey|c_custkey", None, True),
    (2, 0, "DELETE", "orders", "", "", "DELETE" + BULK, True),
    (3, 0, "UPDATE", "part", "", "p_size|p_partkey", None, True),
    (4, 0, "DROP", "lineitem", "", "", DDL + "DROP", True),
    (5, 0, "SELECT", "ghost_table|nation", "", "n_nationkey", None, True),
    (6, 0, "SELECT", "customer", "customer.nope|customer.c_custkey", "c_custkey", None, True),
    (7, 0, None, "", "", "", None, True),
    (8, 0, "SELECT", "part|t", "", "", None, True),
    (9, 0, "SELECT", "nation", "", "n_nationkey", None, True),
    (10, 0, "SELECT", "part", "", "p_partkey", None, True),
    (11, 0, "TRUNCATETABLE", "events", "", "", DDL + "TRUNCATE", True),
    (11, 1, "SELECT", "", "", "", None, True),
    (12, 0, "UPDATE", "orders", "", "o_custkey", "UPDATE" + BULK, True),
    (13, 0, "INSERT", "supplier", "", "", None, True),
    (13, 1, "SELECT", "supplier", "", "s_suppkey", None, True),
    (14, 0, "INSERT", "part|supplier", "", "", None, True),
    (15, 0, "SELECT", "orders", "", "o_orderdate", None, True),
    (16, 0, "SELECT", "part", "", "p_size", None, True),
    (17, 0, "SELECT", "ghost", "", "", None, True),
    (18, 0, "SELECT", "orders|ghost", "", "o_orderkey", None, True),
    (19, 0, None, "", "", "", None, False),
    (20, 0, None, "", "", "", None, False),
    (21, 0, None, "", "", "", None, False),
    (22, 0, "SELECT", "orders", "", "o_orderkey", "DELETE" + BULK, True),
    (23, 0, "UNION", "part|supplier", "", "p_partkey|s_suppkey", None, True),
    (24, 0, "SELECT", "nation|customer", "", "n_name", None, True),
    (25, 0, "SELECT", "orders|ghost", "", "o_orderkey", None, True),
    (26, 0, "MERGE", "orders|ghost", "", "o_orderkey", None, True),
    (27, 0, "SELECT", "ghost", "", "", None, True),
    (28, 0, "SELECT", "ghost", "", "", None, True),
    (29, 0, "DELETE", "orders|ghost", "", "o_orderkey", None, True),
    (30, 0, None, "", "", "", None, False),
    (31, 0, None, "", "", "", None, False),
    (32, 0, None, "", "", "", None, False),
    (33, 0, None, "", "", "", None, False),
    (34, 0, None, "", "", "", None, False),
    (35, 0, "SELECT", "orders", "", "", None, True),
    (36, 0, "SELECT", "orders", "", "", None, True),
    (37, 0, "SELECT", "", "", "", None, True),
    (38, 0, "SELECT", "r|orders", "", "o_orderkey", None, True),
    (39, 0, None, "", "", "", None, False),
    (40, 0, "SELECT", "orders|ghost", "o.o_orderkey|g.id", "o_orderkey", None, True),
    (41, 0, "UPDATE", "part|ghost", "", "p_size", "UPDATE" + BULK, True),
]
# The tables without names of WITH, where there are any.
OWN_TABLES = {8: "part", 38: "orders"}


def fact_parts(scoped: bool) -> str:
    facts = [(*f[:3], OWN_TABLES.get(f[0], f[3]) if scoped else f[3], *f[4:]) for f in FACTS]
    return values("facts", "i, n, kind, tbs, prs, wds, d, ok", facts) + ", " + values("rfs", "i, refs, strict", REFS)


SQL["sql_table_refs"] = (
    f"WITH {values('rfs', 'i, refs, strict', REFS)} SELECT event_id AS query_id, refs, coalesce(strict, refs) AS strict_refs"
    f" FROM events JOIN rfs ON i = event_id % {len(REFS)}"
)
SQL["text_identifiers"] = (
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat("
    r"regexp_extract_all(x, '\b([a-z]+_[a-z][a-z0-9_]*(?:_[a-z][a-z0-9_]*)*)\b', 1),"
    r" list_transform(regexp_extract_all(x, '\b([A-Z][A-Z]+(?:_[A-Z][A-Z]+)+)\b', 1), lambda w: lower(w))),"
    r" list_transform(regexp_extract_all(x, '\b([A-Z][a-z]+[A-Z][a-zA-Z]*)\b', 1), lambda w: lower(w))))), ',') AS tokens"
    " FROM (SELECT doc_id, 'see order_line, ORDER_LINE and OrderLine: ' || text AS x FROM documents)"
)
KPI_ITEMS = (
    "items AS (SELECT p_partkey % 100 AS database_id, p_partkey AS item_id, 'SELECT count(*) FROM ' || CASE p_partkey % 3 WHEN 0 THEN 'orders'"
    " WHEN 1 THEN 'Part' ELSE 'part_ledger' END || ' JOIN customer ON 1 = 1' AS sql_query FROM part)"
)
SQL["grounded_items"] = with_parts("tabs") + f", {KPI_ITEMS} " + (
    "SELECT items.* FROM items WHERE item_id % 3 <> 2 OR NOT EXISTS (SELECT 1 FROM tabs WHERE tabs.database_id = items.database_id)"
)
SQL["unknown_identifiers"] = with_parts("tabs", "cols") + f", {KPI_ITEMS} " + (
    "SELECT database_id, item_id, token FROM items CROSS JOIN (VALUES ('o_orderkey'), ('p_size'), ('big_spender')) v(token)"
    " WHERE NOT EXISTS (SELECT 1 FROM cols WHERE cols.database_id = items.database_id AND lower(column_name) = token)"
)
EXTRACT = r"""
text1 AS (SELECT *, trim(coalesce(answer, '')) AS a FROM ans),
text2 AS (SELECT *, CASE WHEN contains(a, '```') THEN trim(regexp_extract(a, '(?is)```(?:sql)?\s*\n?(.*?)\n?```', 1)) ELSE a END AS b FROM text1),
text3 AS (SELECT *, trim(regexp_replace(b, '^(SQL|sql)\s*:\s*', '')) AS c FROM text2),
got AS (SELECT *, coalesce(nullif(trim(regexp_extract(c, '(?is)\b((?:SELECT|INSERT|UPDATE|DELETE|WITH)\b.*?;)', 1)), ''),
  CASE WHEN regexp_matches(c, '(?i)^(SELECT|WITH)') THEN c END, '') AS x FROM text3),
flag AS (SELECT *, regexp_matches(x, '(?i)\bSELECT\s+(0\b|NULL\b|\d+\s+AS\s+)') AS stand_in FROM got)"""
WITH_ANSWERS = f"WITH {log_cte()}, {answers_cte()}, {EXTRACT} "
SQL["extracted_sql"] = WITH_ANSWERS + "SELECT query_id, x AS sql, stand_in FROM flag"
NO_ANSWER = "'Question cannot be answered using the available database schema.'"
STATUS = f"""status AS (SELECT *, CASE WHEN table_count = 0 THEN 'none' WHEN upper(a) LIKE 'OUT_OF_SCOPE%' THEN 'declined' WHEN x = '' THEN 'nosql' WHEN stand_in THEN 'stand' ELSE 'ok' END AS kind FROM flag),
gen AS (SELECT database_id, query_id, CASE WHEN kind = 'ok' THEN 'SUCCESS' ELSE 'OUT_OF_SCOPE' END AS status, CASE WHEN kind = 'ok' THEN x ELSE '' END AS sql,
 CASE kind WHEN 'none' THEN 'Question cannot be answered using the available database schema — no matching tables found.'
  WHEN 'declined' THEN coalesce(nullif(trim(substr(a, 14)), ''), 'Question cannot be answered using the ') WHEN 'ok' THEN NULL ELSE {NO_ANSWER} END AS reason,
 CASE kind WHEN 'nosql' THEN 'LLM did not return a valid SQL statement' WHEN 'stand' THEN 'LLM returned placeholder SQL instead of a real query' END AS explanation,
 CASE WHEN kind = 'ok' THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM status)"""
SQL["answer_status"] = WITH_ANSWERS + f", {STATUS} SELECT query_id, status, sql, reason, explanation, confidence FROM gen"


def audit(source: str, first: bool = True, scoped: bool = False) -> str:
    """Verdicts from the facts; ``source`` may hold blank statements for some entries."""
    return rf"""
{fact_parts(scoped)},
st AS (SELECT database_id, query_id, facts.* FROM {source} JOIN facts ON i = query_id % {len(REFS)} AND {"n = 0" if first else "TRUE"}
  WHERE trim(coalesce(sql, '')) <> '' UNION ALL
  SELECT database_id, query_id, -1, 0, NULL, '', '', '', NULL, TRUE FROM {source} WHERE trim(coalesce(sql, '')) = ''),
rf AS (SELECT * FROM (SELECT database_id, query_id, n, unnest(string_split(tbs, '|')) AS tb FROM st) WHERE tb <> ''),
badt AS (SELECT query_id, n, 0 AS kind, 'Table ''' || tb || ''' not found in enriched metadata' AS m FROM rf WHERE NOT EXISTS
  (SELECT 1 FROM tabs WHERE tabs.database_id = rf.database_id AND table_name = tb)),
pr AS (SELECT * FROM (SELECT database_id, query_id, n, unnest(string_split(prs, '|')) AS pair FROM st) WHERE pair <> ''),
badc AS (SELECT query_id, n, 1 AS kind, 'Column ''' || split_part(pair, '.', 2) || ''' not found in table ''' || split_part(pair, '.', 1) || '''' AS m FROM pr
  WHERE EXISTS (SELECT 1 FROM tabs WHERE tabs.database_id = pr.database_id AND table_name = split_part(pair, '.', 1))
  AND NOT EXISTS (SELECT 1 FROM cols WHERE cols.database_id = pr.database_id AND table_name = split_part(pair, '.', 1) AND column_name = split_part(pair, '.', 2))),
errs AS (SELECT query_id, n, string_agg(m, '; ' ORDER BY kind, m) AS e FROM (SELECT DISTINCT * FROM (SELECT * FROM badt UNION ALL SELECT * FROM badc)) GROUP BY ALL),
wd AS (SELECT database_id, query_id, n, unnest(string_split(wds, '|')) AS w FROM st),
us AS (SELECT wd.query_id, wd.n, string_agg(DISTINCT w, ',' ORDER BY w) AS u FROM wd JOIN cols ON cols.database_id = wd.database_id AND column_name = w
  SEMI JOIN rf ON rf.query_id = wd.query_id AND rf.n = wd.n AND rf.tb = cols.table_name GROUP BY 1, 2),
aud AS (SELECT s.database_id, s.query_id, s.n AS statement_no, i = -1 AS blank, e IS NULL AND ok AND i <> -1 AS is_valid,
  CASE WHEN i = -1 THEN 'Empty or None SQL statement' WHEN NOT ok THEN 'SQL syntax error: not a statement' ELSE concat_ws('; ', e, d) END AS errors,
  CASE WHEN i = -1 OR NOT ok OR e IS NOT NULL THEN 0.0 WHEN d IS NOT NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
  CASE WHEN e IS NULL AND ok THEN kind END AS statement_type,
  CASE WHEN e IS NULL AND ok AND i <> -1 THEN array_to_string(list_sort(string_split(tbs, '|')), ',') END AS tables_used,
  CASE WHEN e IS NULL AND ok AND i <> -1 THEN coalesce(u, '') END AS columns_used
  FROM st s LEFT JOIN errs ON errs.query_id = s.query_id AND errs.n = s.n LEFT JOIN us ON us.query_id = s.query_id AND us.n = s.n)"""


WITH_LOG = with_parts("tabs", "cols") + f", {log_cte()}"
SQL["sql_audit"] = WITH_LOG + f", {audit('log')} SELECT * EXCLUDE (blank) FROM aud"
SQL["sql_audit_scoped"] = WITH_LOG + f", {audit('log', scoped=True)} SELECT * EXCLUDE (blank) FROM aud"
SQL["sql_audit_all"] = WITH_LOG + f", {audit('log', False)} SELECT query_id, statement_no, is_valid, confidence FROM aud"
SQL["final_responses"] = WITH_LOG + f", {answers_cte()}, {EXTRACT}, {STATUS}, {audit('gen')} " + (
    "SELECT g.query_id, CASE WHEN g.status = 'SUCCESS' AND is_valid THEN 'SUCCESS' ELSE 'OUT_OF_SCOPE' END AS status,"
    " CASE WHEN g.status = 'SUCCESS' AND is_valid THEN g.sql ELSE '' END AS sql,"
    " CASE WHEN g.status = 'SUCCESS' AND NOT is_valid THEN 'Question cannot be answered using the available database schema — generated SQL references unknown schema elements.' ELSE g.reason END AS reason,"
    " CASE WHEN g.status = 'SUCCESS' AND is_valid THEN least(g.confidence, a.confidence) ELSE 0.0 END AS confidence"
    " FROM gen g JOIN aud a ON a.query_id = g.query_id"
)

# ----------------------------------------------------------------- L: insights


def given(prefix: str, c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN {prefix} || {c} ELSE '' END"


NL = "chr(10)"
SQL["schema_context"] = with_parts("etabs", "ecols", "rels", "pairs", "cases", "samples") + f"""
, lst AS (SELECT database_id, t, string_agg('  - ' || column_name || ' (' || data_type || ')' || CASE WHEN coalesce(semantic_type, '') <> '' THEN '  [' || semantic_type || ']' ELSE '' END
   || {given("'  '", 'description')} || CASE WHEN is_primary_key THEN '  PK' ELSE '' END, {NL} ORDER BY position) AS l FROM ecols GROUP BY ALL),
blk AS (SELECT q.database_id, table_ordinal, 'Table: ' || table_name || {given(f"{NL} || '  Description: '", 'description')} || {given(f"{NL} || '  Role: '", 'business_role')}
   || {given(f"{NL} || '  Domain: '", 'domain')} || coalesce({NL} || l, '') || {NL} AS b FROM etabs q LEFT JOIN lst ON lst.database_id = q.database_id AND lst.t = q.t),
bp AS (SELECT database_id, domain, string_agg(table_name, ', ' ORDER BY table_ordinal) AS ts, min(table_ordinal) AS o FROM etabs WHERE domain IS NOT NULL GROUP BY 1, 2)
SELECT database_id, 1 AS section_no, CAST(0 AS BIGINT) AS part_no, string_agg(b, {NL} ORDER BY table_ordinal) AS text FROM blk GROUP BY 1 UNION ALL
SELECT database_id, 2, 0, '### Foreign Key Relationships' || {NL} || string_agg('  ' || from_table || '.' || from_column || '  ->  ' || to_table || '.' || to_column, {NL} ORDER BY f) FROM rels GROUP BY 1 UNION ALL
SELECT database_id, 3, 0, '### Entity Relationships' || {NL} || string_agg('  ' || entity || '  ->  ' || related_entities || {given("'  :  '", 'business_meaning')}, {NL} ORDER BY ordinal) FROM pairs GROUP BY 1 UNION ALL
SELECT database_id, 4, 0, '### Business Processes' || {NL} || string_agg('  ' || domain || ':  ' || ts, {NL} ORDER BY o) FROM bp GROUP BY 1 UNION ALL
SELECT database_id, 5, 0, '### Use Cases' || {NL} || string_agg('  ' || name || ':  ' || description || {NL} || '    Tables: ' || involved_tables, {NL} ORDER BY ordinal) FROM cases GROUP BY 1 UNION ALL
SELECT database_id, 6, 0, '### Sample Queries' || {NL} || string_agg('  Question: ' || question || {NL} || '  SQL: ' || sql, {NL} ORDER BY ordinal) FROM samples GROUP BY 1
"""
SQL["domain_scope"] = with_parts("etabs", "pairs") + """
, dt AS (SELECT database_id, lower(domain) AS low, string_agg(table_name, ', ' ORDER BY table_ordinal) AS ts FROM etabs WHERE domain IS NOT NULL GROUP BY 1, 2),
al AS (SELECT database_id, string_agg(table_name, ', ' ORDER BY table_ordinal) AS ts FROM etabs GROUP BY 1),
ds AS (SELECT database_id, string_agg(domain, ', ' ORDER BY domain) AS ds FROM (SELECT DISTINCT database_id, domain FROM etabs WHERE trim(coalesce(domain, '')) <> '') GROUP BY 1),
req AS (SELECT database_id, CASE k % 4 WHEN 0 THEN 'reference data' WHEN 1 THEN 'Astronomy' END AS domain, CASE WHEN k % 3 = 0 THEN 'customer' END AS entity FROM dbs),
nt AS (SELECT database_id, string_agg('The ''customer'' entity is related to: ' || related_entities || ' (' || business_meaning || ').', ' ' ORDER BY ordinal) AS notes FROM pairs WHERE lower(entity) = 'customer' GROUP BY 1),
tx AS (SELECT r.database_id, concat_ws(' ',
  CASE WHEN r.domain IS NOT NULL THEN 'DOMAIN FILTER: Focus on the ''' || r.domain || ''' domain. ' || coalesce('Relevant tables for this domain: ' || dt.ts || '.',
    'No tables are explicitly tagged with the ''' || r.domain || ''' domain. Choose the most relevant tables from: ' || coalesce(al.ts, '') || '.')
  ELSE nullif(concat_ws(' ', 'DOMAIN OVERVIEW — The schema contains these actual domains: ' || ds.ds || '.', 'All tables in the schema: ' || al.ts ||
    '. Generate insights that span these tables and domains — do NOT introduce domains or tables that are not listed above.'), '') END,
  'ENTITY FOCUS: Prioritize insights related to ''' || entity || '''.', CASE WHEN entity IS NOT NULL THEN notes END) AS x
  FROM req r LEFT JOIN dt ON dt.database_id = r.database_id AND dt.low = lower(r.domain) LEFT JOIN al ON al.database_id = r.database_id
  LEFT JOIN ds ON ds.database_id = r.database_id LEFT JOIN nt ON nt.database_id = r.database_id)
SELECT database_id AS request_id, database_id, CASE WHEN x = '' THEN 'No domain or entity filter — cover all aspects of the business domain reflected in the schema context.' ELSE x END AS text FROM tx
"""
CATEGORY = "CASE WHEN c_custkey % 5 = 0 THEN 'Overview' ELSE 'Finance' END"
SQL["insight_rows"] = f"""
SELECT c_custkey AS connection_id, {CATEGORY} AS category_name, 'kpis' AS section, CAST(0 AS BIGINT) AS ordinal, 'n' || c_custkey || '||||' AS fields FROM customer UNION ALL
SELECT c_custkey, {CATEGORY}, 'insights', 0, 'f|||0.5' FROM customer UNION ALL
SELECT c_custkey, {CATEGORY}, 'insights', 1, '||i|0.0' FROM customer UNION ALL
SELECT c_custkey, {CATEGORY}, 'art_of_the_possible', 0, 't' || c_custkey || '||||' FROM customer UNION ALL
SELECT c_custkey, 'Sales', 'insights', 0, 's|||0.0' FROM customer WHERE c_custkey % 5 <> 0
"""
SQL["category_runs"] = f"""
SELECT c_custkey AS connection_id, c AS category, nullif(c, 'Overview') AS domain, CASE WHEN c = {CATEGORY} THEN 1 ELSE 0 END AS kpis,
 CASE WHEN c = {CATEGORY} THEN 2 WHEN c = 'Sales' AND c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS insights, 0 AS opportunities,
 CASE WHEN c = {CATEGORY} THEN 1 ELSE 0 END AS art_of_the_possible
FROM customer CROSS JOIN (VALUES ('Overview'), ('Operations'), ('Finance'), ('Marketing'), ('Sales'), ('Human Resources'), ('IT')) v(c)
"""

# ---------------------------------------------------------------- M: snapshots

CONN = """WITH conn AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN 'Market ' || c_mktsegment END AS description,
 CASE c_custkey % 5 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'oracle' WHEN 3 THEN 'sqlite' ELSE 'sqlserver' END AS database_type,
 CASE WHEN c_custkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_custkey % 4 + 1 END AS table_count,
 TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 1000 AS INT)) AS created_at, TIMESTAMP '2024-06-01' AS updated_at,
 CASE WHEN c_custkey % 6 = 0 THEN '{}' ELSE '{"tables": [' || array_to_string(list_transform(range(c_custkey % 4 + 1), lambda i: '{"table_name": "t' || i || '"}'), ', ') || ']}' END AS enriched_schema,
 '{"b": 1, "a": ' || c_custkey % 10 || '}' AS insights FROM customer) """
SUMMARY = "id, name, description, database_type, status, table_count::INT AS table_count, 0 AS view_count, created_at, updated_at"
SQL["new_connections"] = CONN + (
    f"SELECT id, name, description, database_type, status, {NONE} AS error_message, created_at, 64 AS hash_length FROM conn"
)
SQL["connection_page"] = CONN + (
    f"SELECT {SUMMARY} FROM conn WHERE status = 'active' AND database_type = 'mysql' ORDER BY created_at DESC, id LIMIT 5 OFFSET 5"
)
SQL["connection_search"] = CONN + (
    f"SELECT {SUMMARY} FROM conn WHERE name ILIKE '%Customer#0000000_2%' OR description ILIKE '%Customer#0000000_2%' ORDER BY"
    " CASE WHEN name ILIKE 'Customer#0000000_2' THEN 0 WHEN name ILIKE 'Customer#0000000_2%' THEN 1 ELSE 2 END, created_at DESC, id LIMIT 15"
)
SQL["connection_lookup"] = CONN + (
    ", gone AS (SELECT DISTINCT s_suppkey * 3 AS id FROM supplier) SELECT id, 'kept' AS state FROM conn WHERE id NOT IN (SELECT id FROM gone)"
    " UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM conn) THEN 'deleted' ELSE 'not found' END FROM gone"
)
SQL["connection_patches"] = CONN + (
    "SELECT id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'error' ELSE status END AS status,"
    " CASE WHEN s_suppkey % 3 = 0 THEN 'lost' END AS error_message,"
    " CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN TIMESTAMP '2030-01-01' ELSE updated_at END AS updated_at FROM conn LEFT JOIN supplier ON s_suppkey = id"
)
SQL["refreshed_schemas"] = CONN + (
    "SELECT id, coalesce('{\"tables\": [\"' || s_name || '\"]}', enriched_schema) AS enriched_schema, CASE WHEN s_suppkey IS NULL THEN insights ELSE '{}' END AS insights,"
    " s_suppkey IS NOT NULL AS no_hash, CASE WHEN s_suppkey IS NULL THEN status ELSE 'active' END AS status,"
    " CASE WHEN s_suppkey IS NULL THEN updated_at ELSE TIMESTAMP '2030-01-01' END AS updated_at FROM conn LEFT JOIN supplier ON s_suppkey = id"
)
SQL["changed_payloads"] = CONN + (
    "SELECT id, CASE WHEN id % 4 = 0 THEN '{\"a\": 77, \"b\": 1}' ELSE insights END AS insights,"
    " CASE WHEN id % 4 = 0 THEN TIMESTAMP '2030-01-01' ELSE updated_at END AS updated_at FROM conn"
)
ITEMS = """WITH base AS (SELECT p_partkey % 20 AS connection_id, p_type AS category, CASE p_size % 4 WHEN 0 THEN 'kpis' WHEN 1 THEN 'insights' WHEN 2 THEN 'opportunities' ELSE 'art_of_the_possible' END AS section,
 p_partkey AS ordinal, p_name AS name, p_size AS size FROM part),
o AS (SELECT * FROM base WHERE ordinal % 5 <> 0), n AS (SELECT * REPLACE (CASE WHEN ordinal % 3 = 0 THEN size + 100 ELSE size END AS size) FROM base WHERE ordinal % 7 <> 0) """
SAME = "x.connection_id = y.connection_id AND x.category = y.category AND x.section = y.section AND x.name = y.name AND x.size = y.size"
SQL["snapshot_delta"] = ITEMS + (
    ", d AS (SELECT connection_id, category, section, ordinal, CASE WHEN EXISTS (SELECT 1 FROM o y WHERE "
    + SAME + ") THEN 'unchanged' ELSE 'added' END AS change FROM n x UNION ALL"
    " SELECT DISTINCT ON (connection_id, category, section, name, size) connection_id, category, section, NULL, 'removed' FROM o x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE "
    + SAME + ")) SELECT connection_id, category, section, change, count(*) AS n, sum(ordinal)::BIGINT AS ordinals FROM d GROUP BY 1, 2, 3, 4"
)
SQL["changed_sections"] = ITEMS + (
    "SELECT connection_id, category, count(*) FILTER (differs) AS changed_sections FROM (SELECT connection_id, category, section,"
    " bool_or(x.name IS DISTINCT FROM y.name OR x.size IS DISTINCT FROM y.size) AS differs FROM o x FULL JOIN n y USING (connection_id, category, section, ordinal)"
    " GROUP BY 1, 2, 3) GROUP BY 1, 2"
)
SQL["snapshot_delta_stored"] = SQL["snapshot_delta"]
SQL["changed_sections_stored"] = SQL["changed_sections"]
SQL["merged_categories"] = ITEMS + (
    ", s AS (SELECT * FROM n WHERE category IN ('ECONOMY', 'PROMO')) SELECT * FROM s UNION ALL SELECT * FROM o WHERE NOT EXISTS"
    " (SELECT 1 FROM s WHERE s.connection_id = o.connection_id AND s.category = o.category)"
)
SQL["failed_documents"] = (
    "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '{\"tables\": [' WHEN 1 THEN ' ' WHEN 2 THEN '{\"tables\": 5}' WHEN 3 THEN '[1]'"
    " ELSE '{\"tables\": [], \"schema\": \"' || c_name || '\"}' END AS document, CASE WHEN c_custkey % 5 = 4 THEN 'active' ELSE 'error' END AS status,"
    " CASE c_custkey % 5 WHEN 0 THEN 'document is not valid JSON' WHEN 1 THEN 'document is empty' WHEN 2 THEN 'tables is not a list'"
    " WHEN 3 THEN 'document is not an object' END AS error_message FROM customer"
)

# ----------------------------------------------------------------- N: browsing

SQL["browse_stats"] = with_parts("tabs", "cols", "vws", "rels") + f", {CONSTRAINTS}, {COUNTS} " + (
    "SELECT database_id, tables_count AS total_tables, views_count AS total_views, columns_count AS total_columns, relationships_count AS total_relationships,"
    " (SELECT count(*) FROM cons x WHERE x.database_id = counts.database_id) AS total_constraints,"
    " (SELECT count(*) FROM cols x WHERE x.database_id = counts.database_id AND is_primary_key) AS total_pks,"
    " (SELECT count(*) FROM (SELECT DISTINCT database_id, from_table, from_column FROM rels) x WHERE x.database_id = counts.database_id) AS total_fks FROM counts"
)
SQL["name_search"] = with_parts("tabs", "vws") + (
    "SELECT database_id, 'table' AS kind, table_name AS name FROM tabs WHERE lower(table_name) LIKE '%order%' UNION ALL"
    " SELECT database_id, 'view', view_name FROM vws WHERE lower(view_name) LIKE '%order%'"
)
SQL["connection_filter"] = CONN + (
    "SELECT id, name, database_type FROM conn WHERE lower(name) LIKE '%sql%' OR lower(coalesce(description, '')) LIKE '%sql%' OR lower(database_type) LIKE '%sql%'"
)
SQL["column_details"] = with_parts("cols", "rels") + f", {CONSTRAINTS} " + (
    ", a AS (SELECT database_id, table_name, column_name, bool_or(constraint_type = 'PRIMARY KEY') AS pk, bool_or(constraint_type = 'FOREIGN KEY') AS fk,"
    " array_to_string(list_sort(list(coalesce(constraint_name, '') || ':' || constraint_type)), ', ') AS c FROM cons GROUP BY 1, 2, 3),"
    " b AS (SELECT database_id, from_table AS table_name, from_column AS column_name, array_to_string(list_sort(list(to_table || '.' || to_column)), ', ') AS r FROM rels GROUP BY 1, 2, 3)"
    " SELECT database_id, table_name, column_name, coalesce(pk, FALSE) AS is_pk, coalesce(fk, FALSE) AS is_fk, coalesce(c, '') AS constraints,"
    " coalesce(r, '') AS \"references\", c IS NOT NULL OR r IS NOT NULL AS has_details FROM cols LEFT JOIN a USING (database_id, table_name, column_name)"
    " LEFT JOIN b USING (database_id, table_name, column_name)"
)
SQL["log_tail"] = (
    "SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS level, props AS message FROM"
    " events WHERE event_type IN ('error', 'purchase') ORDER BY event_id DESC LIMIT 50"
)
SQL["ready_connections"] = CONN + "SELECT id FROM conn WHERE status = 'active' AND table_count > 0"

# ----------------------------------------------------------------- O: workload

SQL["view_order_places"] = (
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
    " LEFT JOIN region ON n_regionkey = r_regionkey"
)
SQL["view_finished_orders"] = (
    "SELECT o_orderkey, c_name, o_orderdate, o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"
)
SQL["view_customer_activity"] = (
    "SELECT c_custkey, c_name, n_name, c_mktsegment, o_orderdate, o_orderstatus FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
    " LEFT JOIN orders ON c_custkey = o_custkey"
)
SQL["view_order_tracking"] = (
    "SELECT o_orderkey, c_name, o_orderstatus, l_linenumber, l_shipdate FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey"
)
SQL["view_line_details"] = (
    "SELECT l_orderkey, l_linenumber, o_orderdate, p_name, p_brand, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
)
SQL["ask_orders_of_segment"] = (
    "SELECT o.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'"
)
SQL["ask_parts_of_type"] = "SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'ECONOMY'"
SQL["ask_order_counts"] = (
    "SELECT c_custkey, c_name, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2"
)
SQL["ask_orders_due"] = (
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= DATE '1998-01-01' + INTERVAL '7 days'"
)
SQL["ask_kpis"] = (
    "SELECT 'Open orders' AS kpi, count(*)::DOUBLE AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL"
    " SELECT 'Revenue', sum(l_extendedprice * (1 - l_discount)) FROM lineitem UNION ALL"
    " SELECT 'Parts sold', count(DISTINCT l_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey"
)

# ------------------------------------------------------------------ P: streams

SQL["stream_ingest"] = SQL["canonical_columns"]
SQL["stream_labels"] = with_parts("cols") + f", {INDICATORS} " + (
    f"SELECT database_id, table_name, column_name, {rule_case('column_name', 'label', ALL_RULES)} AS classification,"
    f" CAST({rule_case('column_name', 'confidence', ALL_RULES)} AS DOUBLE) AS confidence, pattern FROM cols LEFT JOIN inds ON lower(column_name) = indicator"
)
SQL["stream_upsert"] = (
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"
)
SQL["stream_changes"] = (
    "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)"
    " WHERE event_type IS DISTINCT FROM was"
)
SQL["stream_log_tail"] = (
    "SELECT event_id AS seq, 'ERROR' AS level, props AS message FROM events"
    " WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100"
)
SQL["parsed_documents"] = with_parts("cols") + (
    "SELECT database_id, table_name, column_name, is_nullable, is_primary_key FROM cols"
)

# ------------------------------------------------------------------ A: sources

# a script says NOT NULL only where the document's flag is a JSON false
SQL["ddl_columns"] = with_parts("cols") + (
    "SELECT database_id, column_ordinal, table_name, column_name, data_type, is_nullable, is_primary_key FROM cols"
)
SQL["ddl_pieces_columns"] = SQL["ddl_columns"]
SQL["ddl_relationships"] = with_parts("rels") + (
    "SELECT database_id, from_table, from_column, to_table, to_column, from_table || '_' || from_column || '_fkey' AS constraint_name FROM rels"
    " UNION ALL SELECT database_id, 'v_lines', c, NULL, NULL, NULL FROM dbs CROSS JOIN (VALUES ('l_orderkey'), ('tax'), ('n')) v(c)"
)
KEYS = (
    "SELECT database_id, from_table, from_column, to_table, to_column FROM rels {where} UNION ALL"
    " SELECT database_id, table_name, column_name, NULL, NULL FROM cols WHERE is_primary_key"
)
for vendor in ("postgres", "mysql", "oracle", "sqlite"):
    SQL[f"extract_{vendor}"] = with_parts("cols", "rels") + KEYS.format(where="")
SQL["extract_sqlserver"] = with_parts("cols", "rels") + KEYS.format(where="WHERE to_table <> 'missing_customer'")
SQL["extract_columns"] = with_parts("cols", "tabs") + (
    ", tn AS (SELECT database_id, t, row_number() OVER (PARTITION BY database_id ORDER BY table_name) - 1 AS o FROM tabs)"
    " SELECT database_id, row_number() OVER (PARTITION BY database_id ORDER BY o, position, column_name) - 1 AS column_ordinal, o AS table_ordinal,"
    " table_name, column_name, data_type, is_nullable FROM cols JOIN tn USING (database_id, t)"
)
SQL["document_scan"] = with_parts("dbs", "cols") + (
    "SELECT dbs.name, dbs.version, n_columns, n_keys FROM dbs LEFT JOIN (SELECT database_id, count(*) AS n_columns,"
    " count(*) FILTER (is_primary_key) AS n_keys FROM cols GROUP BY 1) USING (database_id)"
)
def n_of(rows: str, what: str = "count(*)") -> str:
    return f"(SELECT CAST({what} AS BIGINT) FROM {rows} x WHERE x.database_id = dbs.database_id)"


SQL["enriched_roundtrip"] = with_parts("tabs", "cols", "rels", "etabs", "ecols", "vws", "ents", "pairs", "cases", "samples") + f", {ISSUES}" + (
    " SELECT database_id, " + ", ".join(
        f"{n_of(rows)} AS {name}" for name, rows in (
            ("n_tables", "etabs"), ("n_columns", "ecols"), ("n_nested_columns", "ecols"), ("n_views", "vws"),
            ("n_relationships", "rels"), ("n_pairs", "pairs"), ("n_use_cases", "cases"), ("n_issues", "issues"),
        )
    ) + f", {n_of('etabs', 'sum(table_ordinal)')} AS table_places FROM dbs"
)
SQL["rule_table_classify"] = SQL["rule_classify_columns"]

# ------------------------------------------------------------------ J: context

CONTEXT = f"""
qs AS (SELECT conv_id * 4294967296 + turn AS question_id, conv_id AS database_id, {digest('text')} AS q FROM conversations WHERE role = 'user'),
ov AS (SELECT *, {digest('text_content')} AS v FROM objects WHERE database_id IN (SELECT database_id FROM qs)),
hits AS (SELECT * FROM (SELECT question_id, qs.database_id, object_type, object_key, table_name, column_name, relationship_type, s AS similarity,
    row_number() OVER (PARTITION BY question_id, object_type ORDER BY s DESC, object_key) AS rank FROM
    (SELECT qs.question_id, qs.database_id, ov.* EXCLUDE (database_id), round(24 * list_dot_product(q, v), 9) AS s FROM qs JOIN ov ON ov.database_id = qs.database_id) qs)
  WHERE rank <= CASE object_type WHEN 'column' THEN 6 ELSE 3 END)"""
MATCHED = (
    "SELECT question_id AS key, database_id, table_name AS t, row_number() OVER (PARTITION BY question_id ORDER BY table_name) - 1 AS i"
    " FROM (SELECT DISTINCT question_id, database_id, table_name FROM hits WHERE object_type IN ('table', 'column'))"
)
PIECES = """
pt AS (SELECT key AS question_id, database_id, t, i, j, hops, tables, nth, row_number() OVER (PARTITION BY key, t ORDER BY i, j, hops, tables, nth) AS r
  FROM (SELECT *, unnest(tables) AS t, unnest(range(len(tables))) AS nth FROM paths)),
seen AS (SELECT question_id, database_id, table_name, similarity, rank AS o1, 0 AS o2, '' AS o3 FROM hits WHERE object_type = 'table' UNION ALL
  SELECT question_id, database_id, t, 0.0, 1048576, i * 2147483648 + j, concat_ws('/', hops, array_to_string(tables, '/'), lpad(nth::VARCHAR, 4, '0')) FROM pt
  WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = pt.question_id AND h.object_type = 'table' AND h.table_name = t)),
fkh AS (SELECT question_id, h.database_id, from_table, from_column, to_table, to_column, similarity FROM hits h JOIN
  (SELECT DISTINCT database_id, from_table, from_column, to_table, to_column FROM rels) r ON r.database_id = h.database_id
  AND object_key = 'relationship:' || from_table || '.' || from_column || '->' || to_table || '.' || to_column),
fkx AS (SELECT DISTINCT question_id, r.database_id, from_table, from_column, to_table, to_column, 0.0 FROM rels r JOIN seen s
  ON s.database_id = r.database_id AND (s.table_name = from_table OR s.table_name = to_table)),
rel AS (SELECT * FROM fkh UNION ALL SELECT * FROM fkx x WHERE NOT EXISTS (SELECT 1 FROM fkh f WHERE f.question_id = x.question_id AND f.from_table = x.from_table
  AND f.from_column = x.from_column AND f.to_table = x.to_table AND f.to_column = x.to_column)),
erh AS (SELECT question_id, h.database_id, p.entity, related_entities, business_meaning FROM hits h JOIN pairs p ON p.database_id = h.database_id
  AND object_key = 'entity_relationship:' || p.entity || '->' || related_entities),
erx AS (SELECT DISTINCT question_id, p.database_id, p.entity, related_entities, business_meaning FROM pairs p JOIN seen s ON s.database_id = p.database_id
  AND upper(substr(table_name, 1, 1)) || lower(substr(table_name, 2)) IN (p.entity, related_entities)),
er AS (SELECT * FROM erh UNION ALL SELECT * FROM erx x WHERE NOT EXISTS (SELECT 1 FROM erh e WHERE e.question_id = x.question_id AND e.entity = x.entity
  AND e.related_entities = x.related_entities)),
jp AS (SELECT DISTINCT key AS question_id, tables, hops FROM paths)
"""
WITH_HITS = with_parts("tabs", "cols", "etabs", "ecols", "rels", "ents", "pairs") + f", {OBJECTS}, {CONTEXT}"
SQL["question_hits"] = WITH_HITS + (
    " SELECT question_id, database_id, object_type, object_key, round(similarity, 6) AS similarity, rank::INT AS rank FROM hits"
)
WITH_CONTEXT = WITH_HITS + f", {FK}" + paths(2, MATCHED) + f", {PIECES}"
SQL["question_context"] = WITH_CONTEXT + """
SELECT question_id, 'table' AS type, table_name AS name, round(similarity, 6) AS similarity, NULL AS "table", NULL AS "from", NULL AS "to", NULL AS tables,
  CAST(NULL AS BIGINT) AS hops, NULL AS entity, NULL AS related_entities, NULL AS business_meaning FROM seen UNION ALL
SELECT question_id, 'column', column_name, round(similarity, 6), table_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM hits WHERE object_type = 'column' UNION ALL
SELECT question_id, 'relationship', NULL, round(similarity, 6), NULL, from_table || '.' || from_column, to_table || '.' || to_column, NULL, NULL, NULL, NULL, NULL FROM rel UNION ALL
SELECT question_id, 'join_path', NULL, NULL, NULL, NULL, NULL, array_to_string(tables, ','), hops, NULL, NULL, NULL FROM jp UNION ALL
SELECT question_id, 'entity_relationship', NULL, NULL, NULL, NULL, NULL, NULL, NULL, entity, related_entities, business_meaning FROM er
"""
SQL["context_summary"] = WITH_CONTEXT + """
SELECT question_id, (SELECT count(*) FROM seen x WHERE x.question_id = qs.question_id) AS table_count,
  (SELECT count(*) FROM hits x WHERE x.question_id = qs.question_id AND object_type = 'column') AS column_count,
  (SELECT count(*) FROM rel x WHERE x.question_id = qs.question_id) AS relationship_count,
  (SELECT count(*) FROM jp x WHERE x.question_id = qs.question_id) AS join_path_count,
  (SELECT count(*) FROM er x WHERE x.question_id = qs.question_id) AS entity_relationship_count,
  coalesce((SELECT string_agg(table_name, ', ' ORDER BY o1, o2, o3) FROM seen x WHERE x.question_id = qs.question_id), '') AS table_names FROM qs
"""
