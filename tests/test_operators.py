from pyspark.sql import functions as F

from skemata.operators import audit, browse, embed, graph, labels, quality, snapshots
from skemata.functions.rules import classify_semantic
from skemata.plans import tenants as T
from skemata.plans.registry import load

EDGE = "database_id bigint, from_table string, from_column string, to_table string, to_column string"


def paths(spark, edges, starts, hops):
    e = spark.createDataFrame([(1, *x) for x in edges], EDGE)
    s = spark.createDataFrame([(1, starts)], "database_id bigint, start_tables array<string>")
    return sorted((tuple(r.tables), r.hops) for r in graph.join_paths(e, s, hops).collect())


def test_join_paths(spark):
    fk = ("employee", "department_id", "dep", "department_id")
    assert paths(spark, [fk], ["employee", "dep"], 3) == [(("employee", "dep"), 1)]
    assert paths(spark, [fk], ["employee", "flight"], 3) == []
    assert paths(spark, [fk], ["employee"], 3) == []
    assert paths(spark, [fk], ["employee", "employee"], 3) == [(("employee",), 0)]
    chain = [("a", "x", "b", "x"), ("b", "y", "c", "y")]
    assert paths(spark, chain, ["a", "c"], 1) == []
    assert paths(spark, chain, ["a", "c"], 2) == [(("a", "b", "c"), 2)]
    two = [("a", "x", "b", "x"), ("a", "y", "b", "x"), ("a", "z", "a", "x")]
    assert paths(spark, two, ["a", "b"], 3) == [(("a", "b"), 1)] * 2
    ring = [("a", "x", "b", "x"), ("b", "x", "c", "x"), ("c", "x", "a", "x")]
    assert paths(spark, ring, ["a", "b"], 3) == [(("a", "b"), 1), (("a", "c", "b"), 2)]
    line = [(f"t{i}", "x", f"t{i + 1}", "x") for i in range(6)]
    assert paths(spark, line, ["t0", "t6"], 6) == [(tuple(f"t{i}" for i in range(7)), 6)]


def test_upsert_twice_is_once(spark):
    schema = "k int, v string, seq int, created_at string, updated_at string"
    base = spark.createDataFrame([(1, "a", 0, "t0", "t0"), (2, "b", 0, "t0", "t0")], schema)
    batch = spark.createDataFrame([(2, "c", 1, None, None), (3, "d", 1, None, None), (2, "e", 2, None, None)], schema)
    once = embed.upsert(base, batch, ["k"], ["seq"], F.lit("t1"))
    twice = embed.upsert(once, batch, ["k"], ["seq"], F.lit("t1"))
    want = {(1, "a", 0, "t0", "t0"), (2, "e", 2, "t0", "t1"), (3, "d", 1, "t1", "t1")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    assert {tuple(r) for r in embed.upsert(base, batch.limit(0), ["k"], ["seq"], F.lit("t1")).collect()} == {
        tuple(r) for r in base.collect()
    }


def test_delta_of_a_list_with_itself(spark):
    rows = spark.createDataFrame([("c", i, f"n{i % 3}") for i in range(6)], "section string, ordinal int, name string")
    items = snapshots.item_hashes(rows, ["name"])
    assert {r.change for r in snapshots.item_delta(items, items, ["section"]).collect()} == {"unchanged"}
    less = items.filter("name <> 'n0'")
    changes = sorted(r.change for r in snapshots.item_delta(items, less, ["section"]).collect())
    assert changes == ["removed"] + ["unchanged"] * 4


def test_payload_hash_ignores_spelling(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}', '{ "b":null,"a":1}', '{"a": 1}')], "x string, y string, z string")
    r = df.select(*[snapshots.payload_hash(F.col(c)).alias(c) for c in "xyz"]).first()
    assert r.x == r.y != r.z


def test_sql_cases(spark):
    log = spark.createDataFrame(
        [(1, i, s) for i, s in enumerate([
            None, "  ", "DROP TABLE employee", "DELETE FROM employee", "DELETE FROM employee WHERE employee_id = 1",
            "UPDATE employee SET x = 1", "SELECT * FROM nonexistent_table", "SELECT employee.nope FROM employee",
            "SELECT employee_id FROM employee", "SELECT 'DROP TABLE x' FROM employee -- DELETE FROM y",
        ])],
        "database_id bigint, query_id int, sql string",
    )
    tables = spark.createDataFrame([(1, "employee")], "database_id bigint, table_name string")
    columns = tables.withColumn("column_name", F.lit("employee_id"))
    got = {r.query_id: r for r in audit.audit_statements(log, tables, columns).collect()}
    assert [got[i].confidence for i in range(10)] == [0.0, 0.0, 0.5, 0.5, 1.0, 0.5, 0.0, 0.0, 1.0, 1.0]
    assert [got[i].is_valid for i in range(10)] == [False, False, True, True, True, True, False, False, True, True]
    assert got[8].columns_used == "employee_id" and got[8].statement_type == "SELECT"
    assert "nonexistent_table" in got[6].errors and "nope" in got[7].errors


def test_statement_scan(spark):
    """Hand-written verdicts: broken, tables, tables but names of WITH."""
    from skemata.functions.sqltokens import scanned

    cases = [
        ("SELECT a FROM (SELECT x FROM t1 WHERE y = 1) x, t2", False, "t1,t2", "t1,t2"),
        ("SELECT * FROM a LEFT JOIN (b JOIN c ON b.x = c.y) ON a.x = b.x, d", False, "a,b,c,d", "a,b,c,d"),
        ("SELECT (SELECT max(y) FROM b WHERE b.k = c.k) m FROM c WHERE EXISTS (SELECT 1 FROM d)", False, "b,c,d", "b,c,d"),
        ("WITH t AS (SELECT 1 FROM a) SELECT * FROM t, (WITH u AS (SELECT 2) SELECT * FROM u) v", False, "a,t,u", "a"),
        ("SELECT * FROM u WHERE x IN (WITH u AS (SELECT 1) SELECT * FROM u)", False, "u", "u"),
        ("(SELECT a FROM x) UNION ALL (SELECT b FROM y) ORDER BY 1", False, "x,y", "x,y"),
        ("INSERT INTO a (x, y) SELECT x, y FROM b ON CONFLICT (x) DO UPDATE SET y = 1", False, "a,b", "a,b"),
        ("INSERT INTO TABLE a VALUES (1)", False, "a", "a"),
        ("DROP TABLE IF EXISTS a, b", False, "a,b", "a,b"),
        ("EXPLAIN ANALYZE SELECT * FROM a", False, "a", "a"),
        ("SELECT a IS NOT DISTINCT FROM b, EXTRACT(YEAR FROM c), TRIM(BOTH 'x' FROM d) FROM e", False, "e", "e"),
        ("SELECT 'it''s; from ghost', $x$ from $$ ghost $x$, E'from g' FROM a -- , ghost", False, "a", "a"),
        ("SELECT * FROM public.a, \"My Table\" m, f(1) g, LATERAL (SELECT 1 FROM b) l", False, "My Table,a,b", "My Table,a,b"),
        ("SELECT CASE WHEN a THEN 1 ELSE LEFT(b, 2) END FROM a WHERE id = ? FOR UPDATE", False, "a", "a"),
        ("SELECT count(*) FILTER (WHERE a > 1) OVER (PARTITION BY b ORDER BY c) FROM a GROUP BY b, c LIMIT 5", False, "a", "a"),
        ("UPDATE a SET x = 1, y = 2 FROM b, c WHERE a.i = b.i", False, "a,b,c", "a,b,c"),
        ("SELECT a, FROM t", True, None, None),
        ("SELECT a FROM t WHERE x = AND y = 1", True, None, None),
        ("SELECT a FROM t ORDER BY", True, None, None),
        ("SELECT a FROM t)", True, None, None),
        ("SELECT a FROM WHERE x = 1", True, None, None),
        ("SELECT \"open FROM t", True, None, None),
        ("WITH t AS SELECT 1", True, None, None),
        ("WITH t AS (SELECT 1)", True, None, None),
        ("UPDATE t WHERE x = 1", True, None, None),
        ("DELETE t WHERE x = 1", True, None, None),
        ("", True, None, None),
    ]
    log = spark.createDataFrame([(1, i, c[0]) for i, c in enumerate(cases)], "database_id bigint, query_id int, sql string")
    got = audit.statements(log).select("query_id", scanned(F.col("tokens")).alias("f")).collect()
    assert len(got) == len(cases)
    for r in got:
        text, broken, tables, own = cases[r.query_id]
        assert r.f.broken == broken, text
        if not broken:
            assert (",".join(sorted(r.f.tables)), ",".join(sorted(r.f.own_tables))) == (tables, own), text


def test_statements_are_cut_outside_literals(spark):
    text = "SELECT 'a;b' FROM x; ; SELECT \";\" FROM y -- ;\n; /* ; */"
    log = spark.createDataFrame([(1, 1, text), (1, 2, " ; "), (1, 3, None)], "database_id bigint, query_id int, sql string")
    got = audit.statements(log, only_first=False).select("query_id", "statement_no", F.size("tokens").alias("n")).collect()
    assert sorted((r.query_id, r.statement_no, r.n) for r in got) == [(1, 0, 4), (1, 1, 4), (2, 0, 0), (3, 0, 0)]


def test_semantic_rules_only(spark):
    df = spark.createDataFrame([("company_city",)], "c string")
    assert df.select(classify_semantic(F.col("c"))["classification"]).first()[0] == "CITY"


def test_scores_stay_in_range(spark, sf):
    rows = load()["quality_scores"](spark, sf).collect()
    for r in rows:
        assert all(0.0 <= r[d] <= 1.0 for d in ("overall_score", *quality.DIMENSIONS))


def test_log_tail(spark):
    log = spark.range(100).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.lit("INFO")).otherwise(F.lit("ERROR")).alias("level"), F.lit("m").alias("message"))
    assert [r.seq for r in browse.log_tail(log, 3, "ERROR").collect()] == [95, 97, 99]
    assert browse.log_tail(log, 50, "ERROR", capacity=10).count() == 5


def test_documents_and_relations_agree(spark, sf):
    from skemata.operators.canonical import canonicalise

    made = canonicalise(T.raw_documents(spark, sf)).columns
    direct = T.catalog(spark, sf).columns.select(*made.columns)
    assert made.exceptAll(direct).count() == 0 and direct.exceptAll(made).count() == 0


def test_hot_paths_stay_in_the_jvm(spark, sf):
    for name in ("rule_classify_columns", "validation_issues", "quality_scores", "join_paths", "sql_audit"):
        plan = load()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan, (name, node)


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = load()["ask_parts_of_type"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,ECONOMY)]" in plan
    assert "p_retailprice" not in plan


def test_batches_are_bounded(spark):
    tables = spark.range(25).select(F.lit(1).cast("bigint").alias("database_id"), F.col("id").alias("table_ordinal"), F.col("id").cast("string").alias("table_name"))
    sizes = labels.column_batches(tables).groupBy("batch_no").count().collect()
    assert sorted(r["count"] for r in sizes) == [5, 10, 10]


def test_stored_snapshots_open_only_what_differs(spark, tmp_path):
    from skemata.operators import snapshot_store as store

    key = ["connection_id", "section"]
    items = spark.range(4000).select(
        (F.col("id") % 200).alias("connection_id"), F.lit("kpis").alias("section"),
        F.sha2((F.col("id") % 900).cast("string"), 256).alias("item_hash"), F.col("id").alias("ordinal"),
    )
    edited = items.withColumn("item_hash", F.when(F.col("ordinal") == 7, F.lit("new")).otherwise(F.col("item_hash")))
    edited = edited.filter("connection_id <> 11").unionByName(items.filter("ordinal = 5").withColumn("ordinal", F.lit(4005).cast("long")))
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    store.write_snapshot(items, old, key), store.write_snapshot(edited, new, key)
    folders = store.differing_folders(spark, old, new)
    assert 1 <= len(folders) <= 3  # connections 7, 11 and 5
    opened = store.items_of(spark, new, folders)
    files = {f.rsplit("folder=", 1)[1].split("/")[0] for f in opened.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files <= set(map(str, folders))
    assert "PartitionFilters: []" not in opened._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(str, df.collect()))
    want = snapshots.item_delta(items, edited, key).groupBy(*key, "change").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("ordinals"))
    assert rows(store.delta_counts(spark, old, new, key)) == rows(want)
    assert rows(store.changed_sections(spark, old, new, ["connection_id"])) == rows(snapshots.changed_sections(items, edited, ["connection_id"]))
    assert store.differing_folders(spark, old, old) == []
