"""Hot keys, long groups and lost lineage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skemata import session
from skemata.operators import graph, insights, labels, search, vector_index
from skemata.plans.graph_queries import ann_recall
from skemata.scale import number_rows, skew_join, text_parts, top_rows, whole_text
from skemata.streaming import flows


def hot_rows(spark, n=3000):
    """A third of all rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )


def test_salted_joins_equal_plain_joins(spark):
    left = hot_rows(spark)
    right = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = skew_join(left, right, ["k"], how, ["v"], salts=7)
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.select(*plain.columns).collect()), key=str)


def test_hot_partition_is_split_at_run_time(spark):
    keep = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    old = {k: spark.conf.get(k, None) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        left = hot_rows(spark, 200_000).withColumn("pad", F.sha2(F.col("v").cast("string"), 256))
        right = spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("w"))
        joined = skew_join(left, right, ["k"], "left", ["v"])
        counted = joined.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.max("pad"))
        rows = counted.collect()
        assert sum(r.n for r in rows) == 200_000
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_are_dense(spark):
    rows = number_rows(hot_rows(spark), ["k"], ["v"], "n").collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.k, []).append((r.v, r.n))
    for pairs in seen.values():
        assert [n for _, n in sorted(pairs)] == list(range(len(pairs)))


def test_text_parts_keep_everything(spark):
    df = spark.range(25).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    line = F.col("o").cast("string")
    parts = {r.part_no: r.text for r in text_parts(df, ["k"], "o", line, "\n", 10).collect()}
    assert len(parts) == 3
    whole = whole_text(df, ["k"], "o", line, "\n", 10).first().text
    assert whole == "\n".join(parts[i] for i in sorted(parts)) == "\n".join(map(str, range(25)))


def test_top_rows_use_a_group_limit(spark):
    top = top_rows(hot_rows(spark), ["k"], [F.col("v")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def _brute(q, v, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(v).T, 9)
    return {(i, j, r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(v)), -s[i]))[:k])}


def test_nearest_both_plans(spark):
    rng = np.random.default_rng(3)
    q, v = rng.standard_normal((7, 5)), rng.standard_normal((60, 5))
    v[40:] = v[0]  # a third of all vectors are copies
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "question_id int, embedding array<double>")
    stored = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "object_key int, embedding array<double>")
    want = _brute(q, v, 8)
    for options in ({}, {"shard_rows": 9}):
        hits = search.nearest(asked, stored, 8, **options).collect()
        assert {(r.question_id, r.object_key, r["rank"]) for r in hits} == want


def shuffled_rows(df):
    """Rows written by the exchanges of a query, as the plan that ran counts them."""
    df.collect()

    def of(plan):
        if "AdaptiveSparkPlan" in plan.nodeName():
            return of(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return of(plan.plan())
        found = plan.metrics().get("shuffleRecordsWritten")
        below = plan.children()
        return (found.get().value() if found.isDefined() else 0) + sum(of(below.apply(i)) for i in range(below.size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_questions_are_not_shuffled_per_shard_bucket_or_cell(spark, tmp_path):
    v = clustered(spark, n=2000, centres=0, spread=1.0)
    asked = v.withColumnRenamed("object_key", "question_id")
    index = vector_index.build_index(v, str(tmp_path / "index"))
    assert index.probes > 4
    for times, hits in (
        (1, search.nearest(asked, v, 5, shard_rows=50)),
        (1, search.nearest_approximate(asked, v, 5, dimensions=32, planes=6)),
        (4, vector_index.search_index(index, asked, v, 5)),
    ):
        # both sides once, and the best rows of each question (the index counts copies, too)
        assert 4000 < shuffled_rows(hits) <= times * (2000 + 2000 + 5 * 2000 + 100)


def test_index_counts_a_hit_per_row_of_its_key(spark, tmp_path):
    v = clustered(spark, n=300, centres=0, spread=1.0)
    asked = v.filter("object_key < 20").withColumnRenamed("object_key", "question_id")
    twice = v.unionAll(v.filter("object_key < 10"))
    index = vector_index.build_index(twice, str(tmp_path / "index"))
    hits = vector_index.search_index(index, asked, twice, 5, probes=len(index.centroids)).collect()
    own = [r["rank"] for r in hits if r.question_id == 3 and r.object_key == 3]
    assert sorted(own) == [1, 2, 3, 4] and len(hits) == 100


def test_nearest_of_blocks_runs_and_splits(spark, monkeypatch):
    """Several tasks, shards, splits and groups, copies, and ties that go to the smaller key."""
    monkeypatch.setattr(search, "TASK_ROWS", 70)
    monkeypatch.setattr(search, "TASK_QUESTIONS", 30)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2), "xyz"[i % 3], rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "object_key long, g int, kind string, embedding array<double>")
    asked = v.select(F.col("object_key").alias("question_id"), "g", "embedding")
    want = set()
    unit = search._matrix([r[3] for r in rows])
    scores = np.round(unit @ unit.T, 9)
    for i, g, _, _ in rows:
        for kind in "xyz":
            mine = [j for j, h, c, _ in rows if h == g and c == kind]
            mine.sort(key=lambda j: (-scores[i, j], j))
            want |= {(i, kind, j, r + 1) for r, j in enumerate(mine[:4])}
    hits = search.nearest(asked, v, 4, ["g"], ["kind"], shard_rows=40)
    assert sorted((r.question_id, r.kind, r.object_key, r["rank"]) for r in hits.collect()) == sorted(want)


def test_approximate_search_finds_most(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("object_key"), "embedding")
    asked = v.withColumnRenamed("object_key", "question_id")
    exact = search.nearest(asked, v, 5)
    near = search.nearest_approximate(asked, v, 5, dimensions=64, planes=2)
    assert search.recall(exact, near, "question_id", "object_key").first().recall > 0.5
    sharded = search.nearest_approximate(
        asked, v, 5, dimensions=64, planes=2, shard_rows=40
    )
    rows = lambda df: sorted((r.question_id, r.object_key, r["rank"]) for r in df.collect())
    assert rows(near) == rows(sharded)


def test_approximate_search_finds_the_share_at_any_number_of_planes(spark):
    """Vectors without any clusters, the hardest case; and the registered query."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = v.select(F.col("vec_id").alias("object_key"), "embedding").cache()
    asked = v.withColumnRenamed("object_key", "question_id").filter("question_id % 4 = 0")
    exact = search.nearest(asked, v, 10).cache()
    for planes in (None, 3, 8):
        near = search.nearest_approximate(asked, v, 10, dimensions=64, planes=planes)
        assert search.recall(exact, near, "question_id", "object_key").first().recall >= 0.9
    assert ann_recall(spark, "/root/testdata/sf0.1").first().recall >= 0.9


def test_streams_across_batches(spark, tmp_path):
    """Keys that come back in later batches, folded state, and changes by the last content."""
    folder, rows = str(tmp_path / "in"), []
    for b in range(7):
        batch = [(b * 10 + i, i % 3, "abc"[(b // 2 + i) % 3]) for i in range(5)]
        rows += batch
        spark.createDataFrame(batch, "n long, k long, v string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("n long, k long, v string").option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "state")
    flows.upsert_stream(stream, ["k"], ["n"], out, str(tmp_path / "c1"), fold_every=3).awaitTermination()
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("batch_id")]) == 7
    got = {(r.k, r.n, r.v) for r in flows.upserted(spark, out, ["k"], ["n"], fold_every=3).collect()}
    last = {}
    for n, k, v in rows:
        last[k] = (k, n, v)
    assert got == set(last.values())
    # the newest fold and what came after it hold everything
    assert {r.k for r in spark.read.parquet(f"{out}/batch_id=5").collect()} == set(last)
    changes = str(tmp_path / "changes")
    flows.changed_stream(stream, ["k"], "n", "v", changes, str(tmp_path / "c2")).awaitTermination()
    want, seen = set(), {}
    for n, k, v in rows:
        if seen.get(k) != v:
            want.add((k, n, v))
        seen[k] = v
    assert {(r.k, r.n, r.v) for r in spark.read.parquet(changes).collect()} == want


def test_map_only_queries_shuffle_nothing(spark, sf):
    from skemata.plans.registry import load

    for name in ("hash_embeddings", "text_identifiers", "sql_table_refs"):
        plan = load()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def clustered(spark, n=6000, centres=60, spread=0.25, seed=5):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((centres, 32)) if centres else np.zeros((1, 32))
    rows = middle[r.integers(0, len(middle), n)] + spread * r.standard_normal((n, 32))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "object_key long, embedding array<double>")


@pytest.mark.parametrize("centres, most", [(60, 0.2), (0, 1.0)])
def test_trained_index_finds_its_share_and_scores_few(spark, tmp_path, centres, most):
    vectors = clustered(spark, centres=centres, spread=0.25 if centres else 1.0).repartition(4)
    asked = vectors.filter("object_key % 40 = 3").withColumnRenamed("object_key", "question_id")
    index = vector_index.build_index(vectors, str(tmp_path / "index"))
    assert index.sizes.sum() == 6000
    exact = search.nearest(asked, vectors, 10)
    near = vector_index.search_index(index, asked, vectors, 10)
    assert search.recall(exact, near, "question_id", "object_key").first().recall >= 0.9
    share = vector_index.scored_share(index, asked)
    print("scored", share, "cells visited", index.probes, "of", len(index.centroids))
    assert share <= most
    # with every cell visited and every vector a candidate, the exact search
    few = asked.limit(5)
    all_ = vector_index.search_index(index, few, vectors, 10, probes=len(index.centroids), candidates=6000)
    same = lambda df: sorted((r.question_id, r["rank"], r.object_key) for r in df.collect())
    assert same(all_) == same(search.nearest(few, vectors, 10))


def test_paths_from_both_ends_are_the_same_and_carry_fewer_rows(spark):
    """Two layers of eight tables on either side of a hub, and a few ways around it."""
    pairs = [("s", f"a{i}") for i in range(8)] + [(f"a{i}", "hub") for i in range(8)]
    pairs += [("hub", f"b{i}") for i in range(8)] + [(f"b{i}", "t") for i in range(8)]
    pairs += [("a0", "a1"), ("b2", "b3"), ("a3", "b3"), ("t", "u"), ("u", "v"), ("a0", "a1")]
    rows = [(1, a, f"c{n % 2}", b, "id") for n, (a, b) in enumerate(pairs)]
    edges = spark.createDataFrame(rows, "database_id long, from_table string, from_column string, to_table string, to_column string")
    starts = spark.createDataFrame([(1, 7, ["s", "t", "v", "s", "nowhere"])], "database_id long, question_id int, start_tables array<string>")
    for hops in (1, 4, 5, 6):
        one, both = (
            sorted((r.i, r.j, r.hops, tuple(r.tables), tuple(map(tuple, r.path))) for r in f(edges, starts, hops).collect())
            for f in (graph.join_paths, graph.join_paths_both_ends)
        )
        assert one == both and len(set(one)) == len(one)
    # rows carried to 6 hops: prefixes of the paths there, halves here
    carried = {(p[0], p[1], p[3][:n], p[4][: n - 1]) for p in one for n in range(1, len(p[3]) + 1)}
    asked = graph.start_pairs(starts).select("database_id", "src", "tgt").distinct().filter("src <> tgt")
    halves = sum(h.count() for h in graph.path_halves(asked, graph.adjacency(edges), 6))
    print("prefixes", len(carried), "halves", halves)
    assert halves < 0.6 * len(carried)


def test_listings_and_context_are_whole_texts(spark):
    """One text per database, also beyond the lines that are joined in one step."""
    n = 4500
    dbs = spark.createDataFrame([(1,), (2,)], "database_id long")
    tables = spark.range(n).select(
        F.lit(1).cast("long").alias("database_id"), F.col("id").alias("table_ordinal"),
        F.format_string("t%04d", "id").alias("table_name"), F.lit("TABLE").alias("table_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("description", "business_role", "domain")],
    )
    columns = tables.select(
        "database_id", "table_ordinal", "table_name", F.col("table_ordinal").alias("column_ordinal"),
        F.lit(0).cast("long").alias("position"), F.lit("c").alias("column_name"), F.lit("int").alias("data_type"),
        F.lit(False).alias("is_primary_key"),
        *[F.lit(None).cast("string").alias(c) for c in ("description", "semantic_type")],
    )
    rels = tables.select(
        "database_id", F.col("table_ordinal").alias("rel_ordinal"), F.col("table_name").alias("from_table"),
        F.lit("c").alias("from_column"), F.lit("t0000").alias("to_table"), F.lit("c").alias("to_column"),
    )
    found = {r.database_id: r for r in labels.table_listing(dbs, tables, columns).collect()}
    assert found[1].text == "\n".join(f"  - t{i:04d}: [c (int)]" for i in range(n))
    assert (found[2].part_no, found[2].text) == (0, "(no tables)")
    found = {r.database_id: r.text for r in labels.relationship_listing(dbs, rels).collect()}
    assert found == {1: "\n".join(f"  - t{i:04d}.c → t0000.c" for i in range(n)), 2: "(no relationships)"}
    none = lambda *fields: spark.createDataFrame([], "database_id long, ordinal long, " + ", ".join(f + " string" for f in fields))
    rows = insights.schema_context(
        tables, columns, rels, none("entity", "related_entities", "business_meaning"), none("domain", "tables"),
        none("name", "description", "involved_tables"), none("question", "sql"),
    ).collect()
    texts = {r.section_no: r.text for r in rows}
    assert len(rows) == 2 and set(texts) == {1, 2}
    assert texts[2] == "### Foreign Key Relationships\n" + "\n".join(f"  t{i:04d}.c  ->  t0000.c" for i in range(n))


def test_relations_larger_than_they_look_are_not_broadcast(spark):
    """An exploded relation looks as small as its keys."""
    own = session._threshold(spark)
    session.shuffle_joins(spark)
    try:
        keys = spark.range(2000).select(F.col("id").alias("k"))
        wide = keys.select("k", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("i"))
        wide = wide.withColumn("pad", F.sha2(F.col("i").cast("string"), 256))

        def plan():
            joined = wide.join(wide.withColumnRenamed("pad", "other"), ["k", "i"])
            out = joined.groupBy("k").agg(F.count("pad").alias("n"), F.max("other"))
            assert sum(r.n for r in out.collect()) == 600_000
            return out._jdf.queryExecution().executedPlan().toString()

        assert "BroadcastHashJoin" not in plan()
        session.broadcast_by_guess(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == own
        assert "BroadcastHashJoin" in plan()
    finally:
        session.shuffle_joins(spark)


def test_tenants_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    """A few bytes of customers make many rows: tasks follow rows, not cores."""
    from skemata.plans import tenants

    monkeypatch.setattr(tenants, "CUSTOMERS_PER_TASK", 10)
    rows = [(i if i % 7 else None, "s") for i in range(400)] + [(5, "s")] * 3
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    dealt = tenants.customers(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 41
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(rows, key=str)


def test_shuffled_joins_stay_small(spark):
    """Compressed sizes decide on tasks and hash joins; in a task the rows take far more.
    Joins of written tables keep what the session came with."""
    from skemata import session

    session.configure(spark)
    assert spark.conf.get(session.PARTITION) == "8MB"
    assert spark.conf.get(session.HASH_JOIN) == "16MB"
    session.broadcast_by_guess(spark)
    assert spark.conf.get(session.PARTITION) == session._given(spark, session.PARTITION) != "8MB"
    assert spark.conf.get(session.HASH_JOIN) == "64MB"
    session.configure(spark)


def written_tenants(spark, folder, asked=()):
    customers = [(i, f"c{i}", 1, 1.0, "s") for i in range(60)] + [(7, "c7", 1, 1.0, "s"), (None, "c", 1, 1.0, "s")]
    spark.createDataFrame(
        customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    turns = [(c, 1, "user", f"orders of {c}") for c in asked] + [(None, 1, "user", "x"), (50, 2, "other", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{folder}/conversations.parquet"
    )
    return str(folder)


def test_relations_of_a_tenant_meet_where_they_are(spark, tmp_path):
    """Only customers, one row per tenant, are shuffled; rows made of them are not."""
    from skemata.plans.catalog_queries import quality_issues, quality_scores_judged
    from skemata.plans.graph_queries import embedding_texts
    from skemata.plans.text_queries import schema_context

    session.configure(spark)
    sf = written_tenants(spark, tmp_path)
    for found in (embedding_texts, schema_context, quality_issues, quality_scores_judged):
        plan = found(spark, sf)._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange" in x]
        assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)


def test_only_tenants_that_are_asked_about_make_rows(spark, tmp_path):
    from skemata.plans import graph_queries, tenants

    session.configure(spark)
    sf = written_tenants(spark, tmp_path, [3, 7, 7, 900])
    cat, lab = graph_queries.asked_about(spark, sf)
    whole = tenants.catalog(spark, sf)
    for mine, every in ((cat.columns, whole.columns), (cat.relationships, whole.relationships)):
        want = every.filter(F.col("database_id").isin(3, 7))
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # rows of 60 tenants' columns were 3,800 and were shuffled for a join with their labels
    assert shuffled_rows(graph_queries.vectors(cat, lab)) < 500
    assert {r.database_id for r in graph_queries.question_hits(spark, sf).collect()} == {3, 7}


def files_of(folder):
    return sorted(str(f) for f in folder.rglob("part-*"))


def test_documents_are_written_compressed(spark, tmp_path):
    from skemata.sources import documents

    items = spark.range(2000).select(
        F.col("id").alias("database_id"), F.lit("tables").alias("section"),
        F.lit(0).cast("long").alias("lead"), F.col("id").alias("ordinal"),
        F.struct(F.col("id").alias("ordinal"), F.lit("orders").alias("table_name")).alias("tables"),
    )
    documents.write_items(items, str(tmp_path / "items"))
    documents.write_enriched(items.select("database_id", "tables"), str(tmp_path / "documents"))
    found = files_of(tmp_path)
    assert found and all(f.endswith(".json.gz") for f in found)
    back = documents.read_items(spark, str(tmp_path / "items"))
    assert back.filter("tables.table_name = 'orders' AND ordinal = database_id").count() == 2000


def test_numbered_rows_are_written_by_columns(spark):
    """Checkpoints of the rows took most of the disk."""
    plan = number_rows(hot_rows(spark), ["k"], ["v"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Scan ExistingRDD" not in plan


def test_documents_are_taken_apart_once(spark, monkeypatch, tmp_path):
    """Sections that read the same relation take it from where it is kept."""
    from skemata.operators import canonical, enrich
    from skemata.plans import tenants

    session.configure(spark)
    raw = tenants.raw_documents(spark, written_tenants(spark, tmp_path))
    monkeypatch.setattr(enrich, "enriched_documents", lambda catalog, answers: catalog)
    catalog, plain = enrich.enrich_raw(raw, None), canonical.canonicalise(raw)
    try:
        for name in ("tables", "columns", "relationships"):
            mine, want = getattr(catalog, name), getattr(plain, name)
            assert mine.storageLevel.useDisk
            plan = mine.groupBy("database_id").count()._jdf.queryExecution().executedPlan().toString()
            assert "InMemoryTableScan" in plan
            assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.catalog.clearCache()
