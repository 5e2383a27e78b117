import json

import pytest
from pyspark.sql import functions as F

from skemata.operators import canonical
from skemata.schemas import ENRICHED_DOCUMENT
from skemata.sources import ddl, ddl_pieces, documents, dumps, rule_files


def catalog_of(spark, *docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return canonical.canonicalise(
        documents.parse_raw(spark.createDataFrame(rows, "database_id bigint, document string"))
    )


def table(name="attendance", columns=(), constraints=(), relationships=()):
    return {
        "table_name": name, "columns": list(columns), "constraints": list(constraints),
        "relationships": list(relationships),
    }


def col(name, **more):
    return {"column_name": name, "data_type": "integer", **more}


def test_keys_nullability_and_edges(spark):
    pk = {"constraint_name": "a_pkey", "constraint_type": "primary key", "column_name": "id"}
    fks = [
        {"constraint_name": n, "constraint_type": "FOREIGN KEY", "column_name": "dept_id"}
        for n in ("first", "last", "")
    ]
    doc = {
        "database_type": "postgresql", "schema": "public", "database_version": "", "version": "15",
        "tables": [table(
            columns=[col("id", nullable=False), col("name"), col("x", nullable="NO"), col("y", nullable=0)],
            constraints=[pk, *fks],
            relationships=[{"child_column": "dept_id", "parent_table": "department", "parent_column": "id"}],
        )],
    }
    cat = catalog_of(spark, doc)
    got = {r.column_name: (r.is_nullable, r.is_primary_key) for r in cat.columns.collect()}
    assert got == {"id": (False, True), "name": (True, False), "x": (True, False), "y": (True, False)}
    rel = cat.relationships.collect()
    assert [(r.from_table, r.to_table, r.constraint_name) for r in rel] == [("attendance", "department", "last")]
    assert cat.databases.first().version == "15"


def test_missing_sections_are_empty(spark):
    cat = catalog_of(spark, {}, {"tables": []}, {"tables": [{"table_name": "t"}]})
    assert cat.columns.count() == 0 and cat.relationships.count() == 0 and cat.views.count() == 0
    assert [r.table_name for r in cat.tables.collect()] == ["t"]
    assert cat.databases.count() == 3


def test_views_and_dense_ordinals(spark):
    doc = {
        "tables": [table("a", [col("x"), col("y")]), table("b"), table("c", [col("z")])],
        "views": [{"view_name": "v", "columns": [{"column_name": "p"}]}],
    }
    cat = catalog_of(spark, doc)
    assert sorted((r.column_ordinal, r.table_ordinal, r.column_name) for r in cat.columns.collect()) == [
        (0, 0, "x"), (1, 0, "y"), (2, 2, "z")
    ]
    view = cat.view_columns.first()
    assert (view.data_type, view.is_nullable, cat.views.first().definition) == ("unknown", True, "")


def test_raw_files_and_enriched_path(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}.json").write_text(json.dumps({"tables": [table(f"t{i}", [col("id")])]}, indent=1))
    docs = documents.read_raw(spark, str(tmp_path))
    assert docs.select("database_id").distinct().count() == 2
    names = {r.table_name for r in canonical.canonicalise(docs).tables.collect()}
    assert names == {"t0", "t1"}
    assert documents.read_enriched(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        documents.read_enriched(spark, str(tmp_path / "none"), missing="error").count()
    assert "metadata" in ENRICHED_DOCUMENT


def test_ddl_subset(spark):
    sql = """
    -- people; and their work
    CREATE TABLE IF NOT EXISTS hr.employee (
      employee_id INTEGER NOT NULL, full_name VARCHAR(100), pay NUMERIC(10, 2) DEFAULT (1 + (2)),
      unique_no INTEGER, since TIMESTAMP WITHOUT TIME ZONE NOT NULL, dept INTEGER REFERENCES dept (id),
      CONSTRAINT pk_emp PRIMARY KEY (employee_id),
      FOREIGN KEY (dept, unique_no) REFERENCES "Dept" (id, "No"), UNIQUE (full_name)
    );
    CREATE VIEW v AS SELECT e.employee_id, full_name AS nm, count(*) FROM employee e;
    """
    scripts = spark.createDataFrame([(1, sql)], "database_id bigint, sql string")
    cat = canonical.canonicalise(ddl.ddl_documents(scripts))
    cols = [(r.column_name, r.data_type, r.is_nullable, r.is_primary_key) for r in cat.columns.orderBy("column_ordinal").collect()]
    assert cols == [
        ("employee_id", "integer", False, True), ("full_name", "varchar(100)", True, False),
        ("pay", "numeric(10, 2)", True, False), ("unique_no", "integer", True, False),
        ("since", "timestamp without time zone", False, False), ("dept", "integer", True, False),
    ]
    rels = {(r.from_column, r.to_table, r.to_column, r.constraint_name) for r in cat.relationships.collect()}
    assert rels == {
        ("dept", "Dept", "id", "employee_dept_fkey"), ("unique_no", "Dept", "No", "employee_unique_no_fkey")
    }
    kinds = {(r.constraint_name, r.constraint_type) for r in cat.constraints.collect()}
    assert ("employee_full_name_key", "UNIQUE") in kinds and ("pk_emp", "PRIMARY KEY") in kinds
    assert [r.column_name for r in cat.view_columns.collect()] == ["employee_id", "nm", "count(*)"]
    inline = canonical.canonicalise(ddl.ddl_documents(scripts, inline_keys=True))
    assert ("dept", "dept", "id") in {(r.from_column, r.to_table, r.to_column) for r in inline.relationships.collect()}


def test_unknown_vendor():
    with pytest.raises(ValueError):
        dumps.extract("dbase", {})


def test_rule_table_finds_first_match(spark):
    columns = spark.createDataFrame(
        [(1, "t", n, i) for i, n in enumerate(["email", "mobile_no", "company_id", "capacity", "status", "foo"])],
        "database_id bigint, table_name string, column_name string, column_ordinal bigint",
    )
    plain, regex = rule_files.split_rules([*rule_files.PII_RULES, *rule_files.SEMANTIC_RULES])
    rules = spark.createDataFrame([(i, *r) for i, r in plain], rule_files.NAME_RULES_SCHEMA)
    got = {
        r.column_name: (r.classification, r.confidence)
        for r in rule_files.classify_by_rule_table(columns, rules, regex).collect()
    }
    assert got == {
        "email": ("EMAIL", 0.95), "mobile_no": ("PHONE", 0.90), "company_id": ("GOVT_ID", 0.98),
        "capacity": ("CITY", 0.85), "status": ("STATUS", 0.85), "foo": (None, 0.0),
    }


def test_rule_files(tmp_path):
    (tmp_path / "pii_rules.yaml").write_text(
        "pii_columns:\n  - {pattern: tax, classification: TAX, confidence: 0.4}\n"
    )
    pii, semantic = rule_files.read_rules(str(tmp_path))
    assert pii == [rule_files.Rule("tax", "TAX", 0.4)] and semantic == []
    assert len(rule_files.read_patterns()) == 5


def test_relationship_key_modes(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None, "c", "x", "p", "y"), ("", "a", "b", "d", "c", "x", "p", "y")],
        ", ".join(f"{n} string" for n in ("from_table", "from_column", "to_table", "to_column",
                                          "child_table", "child_column", "parent_table", "parent_column")),
    )
    truthy = {tuple(r) for r in canonical.normalise_relationship_keys(rows).collect()}
    present = {tuple(r) for r in canonical.normalise_relationship_keys(rows, "present").collect()}
    assert truthy == {("c", "x", "p", "y"), ("c", "a", "b", "d")}
    assert present == {("c", "x", "p", "y"), ("", "a", "b", "d")}


def test_names(spark):
    from skemata.functions.names import describe_relationship, short_name, singular

    words = ["people", "cities", "classes", "courses", "boxes", "glass", "ies", "Orders", "s"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", singular(F.col("w")).alias("s")).collect()}
    assert got == {
        "people": "person", "cities": "city", "classes": "class", "courses": "cours", "boxes": "boxe",
        "glass": "glass", "ies": "ie", "Orders": "Order", "s": "",
    }
    text = spark.createDataFrame(
        [("each employee belongs to a department", None), ("An Environment belongs to exactly one Project (N:1), by id", "Environment"),
         ("A Nation is located in one Region", "Nation"), ("stores", None)],
        "d string, e string",
    )
    named = {r.d: r.n for r in text.filter("e is not null").select("d", short_name(F.col("d"), F.col("e")).alias("n")).collect()}
    assert set(named.values()) == {"belongs to", "located in"}
    plain = [r.n for r in text.filter("e is null").select(short_name(F.col("d")).alias("n")).collect()]
    assert plain == ["belongs to", "stores"]
    rel = spark.createDataFrame(
        [("employee", "department_id", "department", "id"), ("employee", "boss", "employee", "id"),
         ("a", "id", "b", "id"), ("a", "x", "b", "id"), ("staffs", "manager_id", "managers", "id")],
        "a string, b string, c string, d string",
    )
    said = [r.s for r in rel.select(describe_relationship(*[F.col(c) for c in "abcd"]).alias("s")).collect()]
    assert said == [
        "each employee belongs to a department", "each employee references another employee via boss",
        "each a is associated with one b", "each a references b via x", "each staff reports to a manager",
    ]


def test_ddl_literals_and_quotings(spark):
    sql = """
    CREATE TABLE `a` ([c] VARCHAR(5) DEFAULT 'p;q', "d;e" INTEGER NOT NULL, f INT[] DEFAULT '--' ); -- x;
    CREATE TABLE b (g TEXT DEFAULT 'it''s (odd', /* ; */ h DATE);
    CREATE INDEX i ON b (g);
    CREATE TABLE broken;
    """
    scripts = spark.createDataFrame([(1, sql), (2, None), (3, "")], "database_id long, sql string")
    cat = canonical.canonicalise(ddl.ddl_documents(scripts))
    got = [(r.table_name, r.column_name, r.data_type) for r in cat.columns.orderBy("column_ordinal").collect()]
    assert got == [
        ("a", "c", "varchar(5)"), ("a", "d;e", "integer"), ("a", "f", "int[]"), ("b", "g", "text"), ("b", "h", "date"),
    ]
    lost = [r.statement for r in ddl.rejected_statements(scripts).collect()]
    assert lost == ["CREATE INDEX i ON b (g)", "CREATE TABLE broken"]


def test_ddl_pieces_give_what_the_whole_script_gives(spark):
    sql = (
        "CREATE TABLE `a;` ([c] VARCHAR(5) DEFAULT 'p;q''', d INTEGER NOT NULL, f INT[] DEFAULT '--' ); -- x;\n"
        "CREATE TABLE b (g TEXT DEFAULT 'it''s; (odd', /* ; **/ h DATE, \"i-;\" INT DEFAULT 4 - 3 / 1);"
        "INSERT INTO b VALUES ('CREATE TABLE no (a int);');CREATE INDEX i ON b (g);\nCREATE TABLE broken;/*/ ; */"
        "CREATE VIEW v AS SELECT g, '' AS e, ';' AS s FROM b"
    )
    cut = [[sql[:i], sql[i:]] for i in range(len(sql) + 1)]
    cut += [[sql[j : j + n] for j in range(0, len(sql), n)] for n in (1, 2, 3, 7)]
    cut += [[sql[:9], "", "", sql[9:14], "", sql[14:]], [sql], [None], [""]]
    rows = [(i, no, p) for i, parts in enumerate(cut) for no, p in enumerate(parts)]
    pieces = spark.createDataFrame(rows, "database_id long, piece_no int, sql string").repartition(5)
    whole = spark.createDataFrame(
        [(i, "".join(p or "" for p in parts)) for i, parts in enumerate(cut)], "database_id long, sql string"
    )
    for made, want in (
        (ddl_pieces.ddl_documents(pieces), ddl.ddl_documents(whole)),
        (ddl_pieces.rejected_statements(pieces, width=4), ddl.rejected_statements(whole)),
    ):
        text = F.to_json(F.struct(*want.columns)).alias("row")
        got, expected = (sorted((r.database_id, r.row) for r in d.select("database_id", text).collect()) for d in (made, want))
        assert len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            assert a == b, cut[a[0]]


def test_an_extract_runs_no_job_and_numbers_on_request(spark, sf):
    from skemata.plans.source_queries import vendor_dumps

    relations = vendor_dumps(spark, sf, "postgres")
    spark.sparkContext.setJobGroup("extract", "nothing runs here")
    found = dumps.extract("postgres", relations)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("extract") == []
    spark.sparkContext.setJobGroup("other", "")
    catalog = found.catalog()
    for df, name in ((catalog.tables, "table_ordinal"), (catalog.columns, "column_ordinal"), (catalog.relationships, "rel_ordinal")):
        bad = df.groupBy("database_id").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        assert bad.filter("low <> 0 or high <> n - 1").count() == 0
    assert catalog.columns.count() == found.columns.count() > 0
