"""A catalog of many databases, derived from the driver's tables.

Every customer owns one database: a copy of the 14-table test schema, damaged
by arithmetic on the customer key so that every check has something to find.
The same rules are written once more as SQL, so a second engine can derive the
same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.functions.rules import classify
from skemata.plans.registry import read, row_count

# table, then columns as name:type, a star for a primary key, plus for a foreign key
BASE = """
region r_regionkey:integer* r_name:text
nation n_nationkey:integer* n_name:text n_regionkey:integer+
customer c_custkey:bigint* c_name:text c_nationkey:integer+ c_acctbal:numeric c_mktsegment:text
supplier s_suppkey:bigint* s_name:text s_nationkey:integer+ s_acctbal:numeric
part p_partkey:bigint* p_name:text p_brand:text p_type:text p_size:integer+ p_retailprice:numeric
orders o_orderkey:bigint* o_custkey:bigint+ o_orderstatus:text o_totalprice:numeric o_orderdate:timestamp o_orderpriority:text
lineitem l_orderkey:bigint* l_partkey:bigint+ l_suppkey:bigint+ l_linenumber:integer* l_quantity:numeric l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:text l_linestatus:text l_shipdate:timestamp
events event_id:bigint* ts:timestamp user_id:bigint event_type:text value:numeric props:text
documents doc_id:bigint* text:text lang:text source:text n_chars:bigint
embeddings vec_id:bigint* embedding:vector label:integer
pages page_id:bigint* url:text html:text
benchmark item_id:bigint* text:text
labels doc_id:bigint* quality:integer toxic:integer
conversations conv_id:bigint* turn:integer* role:text text:text
"""

# child column, parent column; in order of the child table
BASE_KEYS = """
nation.n_regionkey region.r_regionkey
customer.c_nationkey nation.n_nationkey
supplier.s_nationkey nation.n_nationkey
part.p_size part.p_partkey
orders.o_custkey customer.c_custkey
lineitem.l_orderkey orders.o_orderkey
lineitem.l_partkey part.p_partkey
lineitem.l_suppkey supplier.s_suppkey
lineitem.l_linenumber orders.o_custkey
labels.doc_id documents.doc_id
"""
SELF_KEY, ORDER_KEY, PART_KEY, PARALLEL_KEY = 3, 4, 6, 8

SUFFIXES = {
    1: "_email", 2: "_mobile_no", 3: "_city", 4: "_status",
    5: "_company", 6: "_firstname", 7: "FAX",
}
ROLES = [
    "master_data", "transactional", "reference", "audit", "staging",
    "reporting", "fact", "dimension", "junction",
]
EXTRA_TABLE, EXTRA_COLUMNS = 13, 15
STUB_TABLE = "audit_stub"
# some 80 column rows each, and all of a tenant's rows are joined and grouped in one task
CUSTOMERS_PER_TASK = 2_500


def base_tables() -> list[tuple[int, str, list[tuple[str, str, bool, bool]]]]:
    out = []
    for t, line in enumerate(BASE.strip().splitlines()):
        name, *cols = line.split()
        columns = []
        for spec in cols:
            col, kind = spec.split(":")
            columns.append(
                (col, kind.rstrip("*+"), kind.endswith("*"), kind.endswith(("*", "+")))
            )
        out.append((t, name, columns))
    return out


def base_columns() -> list[tuple]:
    """(t, table, p, g, column, type, is_pk, is_key, is_last)"""
    rows, g = [], 0
    for t, name, columns in base_tables():
        for p, (col, kind, pk, key) in enumerate(columns):
            rows.append((t, name, p, g, col, kind, pk, key, p == len(columns) - 1))
            g += 1
    for i in range(EXTRA_COLUMNS):
        p = len(base_tables()[EXTRA_TABLE][2]) + i
        rows.append(
            (EXTRA_TABLE, base_tables()[EXTRA_TABLE][1], p, g + i, f"attr_{i}", "text", False, True, False)
        )
    return rows


N_BASE = sum(len(c) for _, _, c in base_tables())


def base_keys() -> list[tuple]:
    """(f, child, child column, parent, parent column)"""
    rows = []
    for f, line in enumerate(BASE_KEYS.strip().splitlines()):
        child, parent = line.split()
        rows.append((f, *child.split("."), *parent.split(".")))
    return rows


# ------------------------------------------------------------- Spark expressions


def every(k: Column, n: int, rest: int = 0) -> Column:
    return k % n == rest


def table_name(k: Column, base: Column) -> Column:
    return F.when(every(k, 7), F.initcap(base)).otherwise(base)


def column_name(k: Column, b: Column) -> Column:
    open_last = b["is_last"] & ~b["is_key"]
    even, odd = b["t"] % 2 == 0, b["t"] % 2 == 1
    named = (
        F.when(b["is_key"], b["c"])
        .when(open_last & every(k, 4) & even, F.lit("created_at"))
        .when(open_last & every(k, 4, 1) & even, F.lit("status"))
        .when(open_last & every(k, 4, 2) & odd, F.lit("Tenant_ID"))
    )
    pick = (k * 3 + b["g"]) % 17
    for n, suffix in SUFFIXES.items():
        named = named.when(pick == n, F.concat(b["c"], F.lit(suffix)))
    return named.otherwise(b["c"])


def is_primary(k: Column, b: Column) -> Column:
    return b["pk"] & ~(every(k, 5) & (b["t"] % 3 == 1))


def nullable_json(k: Column, b: Column) -> Column:
    """JSON text of the document's nullable field; null means the field is absent."""
    kind = (k + b["g"]) % 5
    return (
        F.when(kind == 0, F.lit('"NO"'))
        .when(kind == 2, F.lit("false"))
        .when(kind == 3, F.lit("true"))
        .when(kind == 4, F.lit("0"))
    )


def has_tables(k: Column) -> Column:
    return ~every(k, 97, 96)


def parent_table(k: Column, b: Column) -> Column:
    return F.when((b["f"] == ORDER_KEY) & every(k, 11), F.lit("missing_customer")).otherwise(
        table_name(k, b["parent"])
    )


def has_key(k: Column, b: Column) -> Column:
    return (
        F.when(b["f"] == SELF_KEY, every(k, 8))
        .when(b["f"] == PARALLEL_KEY, every(k, 6))
        .otherwise(F.lit(True))
    )


def key_name(k: Column, b: Column) -> Column:
    child = table_name(k, b["child"])
    return F.when(
        every(k, 3), F.concat(F.lit("fk_"), child, F.lit("_"), b["child_column"])
    ).otherwise(F.concat(child, F.lit("_"), b["child_column"], F.lit("_fkey")))


def constraint_name(k: Column, b: Column) -> Column:
    """What the relation keeps: a blank name is no name."""
    return F.when(~((b["f"] == PART_KEY) & every(k, 9, 4)), key_name(k, b))


# -------------------------------------------------------------- literal relations
#
# Rows are computed inside the exploded array, so that what reads a relation
# sees plain attributes and not the arithmetic behind them.


def _sql(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def _structs_text(names: str, rows: list[tuple]) -> str:
    """SQL text of an array of structs: one expression instead of a call per value."""
    fields = names.split()
    return "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {_sql(v)}" for n, v in zip(fields, r)) + ")"
        for r in rows
    ) + ")"


def _structs(names: str, rows: list[tuple]) -> Column:
    return F.expr(_structs_text(names, rows))


COLUMN_FIELDS = "t table p g c type pk is_key is_last"


def _column_literals(extra: bool) -> Column:
    return _structs(COLUMN_FIELDS, [r for r in base_columns() if (r[3] >= N_BASE) == extra])


def _table_literals() -> Column:
    return _structs("t table", [(t, n) for t, n, _ in base_tables()])


def _key_literals(child: str | None = None) -> Column:
    rows = [r for r in base_keys() if child in (None, r[1])]
    return _structs("f child child_column parent parent_column", rows)


def _none_of(rows: Column) -> Column:
    return F.slice(rows, 1, 0)


def customers(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """One row per tenant, of which some 80 rows will be made.

    Tenants are dealt by their key, as two short columns, in pieces of about
    ``CUSTOMERS_PER_TASK`` rows; what is made of them stays there, so relations of a tenant
    meet and are grouped without being shuffled.  With ``among``, only tenants whose
    ``database_id`` it holds; all others go before rows are made of them.
    """
    cust = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("database_id"), F.col("c_mktsegment").alias("segment")
    )
    rows = row_count(spark, sf_dir, "customer")
    if among is not None:
        wanted = among.select("database_id").distinct()
        cust = cust.join(wanted, "database_id", "left_semi")
        rows = min(rows, wanted.count())
    pieces = max(spark.sparkContext.defaultParallelism, -(-rows // CUSTOMERS_PER_TASK))
    return cust.repartition(pieces, "database_id")


def _rows(cust: DataFrame, literals: Column, made, keep=None, *more: str) -> DataFrame:
    """Explode ``made(b)`` for every kept literal ``b``."""
    kept = literals if keep is None else F.filter(literals, keep)
    return (
        cust.filter(has_tables(F.col("database_id")))
        .select("database_id", *more, F.explode(F.transform(kept, made)).alias("r"))
        .select("database_id", "r.*")
    )


def _long(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)


def _all_tables(k: Column) -> Column:
    stub = _structs("t table", [(len(base_tables()), STUB_TABLE)])
    return F.concat(_table_literals(), F.when(every(k, 17), stub).otherwise(_none_of(stub)))


def _all_columns(k: Column) -> Column:
    extra = _column_literals(True)
    return F.concat(
        _column_literals(False), F.when(every(k, 13), extra).otherwise(_none_of(extra))
    )


class TenantCatalog:
    """The fields of ``Catalog``, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> None:
        self.customers = customers(spark, sf_dir, among)
        self.k = F.col("database_id")

    @cached_property
    def databases(self) -> DataFrame:
        k = self.k
        return self.customers.select(
            "database_id",
            F.when(every(k, 23, 5), F.lit("")).otherwise(F.lit("postgresql")).alias("vendor"),
            F.concat(F.lit("tenant_"), k.cast("string")).alias("name"),
            F.when(every(k, 3), F.lit("15.0"))
            .when(every(k, 3, 1), F.lit("14.2"))
            .alias("version"),
        )

    @cached_property
    def tables(self) -> DataFrame:
        k = self.k
        return _rows(
            self.customers,
            _all_tables(k),
            lambda b: F.struct(
                _long(b["t"], "table_ordinal"),
                table_name(k, b["table"]).alias("table_name"),
                F.lit("TABLE").alias("table_type"),
            ),
        )

    @cached_property
    def columns(self) -> DataFrame:
        k = self.k
        return _rows(
            self.customers,
            _all_columns(k),
            lambda b: F.struct(
                _long(b["g"], "column_ordinal"),
                _long(b["t"], "table_ordinal"),
                table_name(k, b["table"]).alias("table_name"),
                _long(b["p"], "position"),
                column_name(k, b).alias("column_name"),
                b["type"].alias("data_type"),
                ((k + b["g"]) % 5 != 2).alias("is_nullable"),
                is_primary(k, b).alias("is_primary_key"),
            ),
        )

    @cached_property
    def relationships(self) -> DataFrame:
        k = self.k
        return _rows(
            self.customers,
            _key_literals(),
            lambda b: F.struct(
                _long(b["f"], "rel_ordinal"),
                table_name(k, b["child"]).alias("from_table"),
                b["child_column"].alias("from_column"),
                parent_table(k, b).alias("to_table"),
                b["parent_column"].alias("to_column"),
                constraint_name(k, b).alias("constraint_name"),
            ),
            lambda b: has_key(k, b),
        )

    @cached_property
    def constraints(self) -> DataFrame:
        return (
            self.columns.filter("is_primary_key")
            .select(
                "database_id",
                "table_name",
                F.concat("table_name", F.lit("_pkey")).alias("constraint_name"),
                F.lit("PRIMARY KEY").alias("constraint_type"),
                "column_name",
            )
            .unionAll(
                self.relationships.select(
                    "database_id",
                    "from_table",
                    "constraint_name",
                    F.lit("FOREIGN KEY"),
                    "from_column",
                )
            )
        )

    @cached_property
    def views(self) -> DataFrame:
        return _views(self.customers).select(
            "database_id", "view_ordinal", "view_name", "definition"
        )

    @cached_property
    def view_columns(self) -> DataFrame:
        return (
            _views(self.customers)
            .select("database_id", "view_name", F.posexplode("cols").alias("position", "v"))
            .select(
                "database_id",
                "view_name",
                F.col("position").cast("bigint").alias("position"),
                F.col("v.column_name").alias("column_name"),
                F.coalesce("v.data_type", F.lit("unknown")).alias("data_type"),
                F.col("v.is_nullable").alias("is_nullable"),
            )
        )


def catalog(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> TenantCatalog:
    return TenantCatalog(spark, sf_dir, among)


ORDER_VIEW = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


def _view_array(k: Column, parts_definition: str | None, made) -> Column:
    """Views of a tenant; ``made(name, type, nullable)`` shapes a view column."""

    def view(when: Column, name: str, text: str | None, cols: list[Column]) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("view_name"),
                F.lit(text).cast("string").alias("definition"),
                F.array(*cols).alias("cols"),
            ),
        )

    both = F.array(
        view(
            every(k, 2),
            "v_orders",
            ORDER_VIEW,
            [made("o_orderkey", "bigint", False), made("c_name", None, None)],
        ),
        view(every(k, 3), "v_parts", parts_definition, [made("p_name", "text", "YES")]),
    )
    return F.filter(both, lambda v: v.isNotNull())


def _views(cust: DataFrame) -> DataFrame:
    k = F.col("database_id")

    def made(name: str, kind: str | None, nullable) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).cast("string").alias("data_type"),
            F.lit(nullable is not False).alias("is_nullable"),
        )

    return (
        cust.filter(has_tables(k))
        .select("database_id", F.posexplode(_view_array(k, "", made)).alias("view_ordinal", "v"))
        .select("database_id", F.col("view_ordinal").cast("bigint").alias("view_ordinal"), "v.*")
    )


# ------------------------------------------------------------------ raw documents

OF_COLUMNS = "array<struct<column_name:string,data_type:string,nullable:variant>>"
OF_CONSTRAINTS = "array<struct<constraint_name:string,constraint_type:string,column_name:string>>"
OF_KEYS = "array<struct<child_column:string,parent_table:string,parent_column:string>>"


def _document_literals() -> Column:
    """Tables with their columns and foreign keys nested inside."""
    key_fields = "f child child_column parent parent_column"
    none = {
        COLUMN_FIELDS: f"slice({_structs_text(COLUMN_FIELDS, base_columns()[:1])}, 1, 0)",
        key_fields: f"slice({_structs_text(key_fields, base_keys()[:1])}, 1, 0)",
    }

    def listed(fields: str, rows: list[tuple]) -> str:
        return _structs_text(fields, rows) if rows else none[fields]

    tables = []
    for t, name, _ in base_tables():
        mine = [r for r in base_columns() if r[0] == t]
        tables.append(
            f"named_struct('table', '{name}',"
            f" 'columns', {listed(COLUMN_FIELDS, [r for r in mine if r[3] < N_BASE])},"
            f" 'more', {listed(COLUMN_FIELDS, [r for r in mine if r[3] >= N_BASE])},"
            f" 'keys', {listed(key_fields, [r for r in base_keys() if r[1] == name])})"
        )
    return F.expr(f"array({', '.join(tables)})")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same catalog as nested documents, as an extract would write them."""
    cust = customers(spark, sf_dir)
    k = F.col("database_id")

    def constraint(name: Column, kind: str, column: Column) -> Column:
        kind = F.when(every(k, 2), F.lit(kind.lower())).otherwise(F.lit(kind))
        return F.struct(
            name.alias("constraint_name"),
            kind.alias("constraint_type"),
            column.alias("column_name"),
        )

    def key_constraints(b: Column) -> Column:
        """An older name first for some; a blank name for others."""
        blank = (b["f"] == PART_KEY) & every(k, 9, 4)
        one = constraint(
            F.when(blank, F.lit("")).otherwise(key_name(k, b)), "FOREIGN KEY", b["child_column"]
        )
        older = constraint(F.lit("older_name"), "FOREIGN KEY", b["child_column"])
        return F.when((b["f"] == ORDER_KEY) & every(k, 5, 1), F.array(older, one)).otherwise(
            F.array(one)
        )

    def document_table(d: Column) -> Column:
        name = table_name(k, d["table"])
        columns = F.when(every(k, 13), F.concat(d["columns"], d["more"])).otherwise(d["columns"])
        keys = F.filter(d["keys"], lambda b: has_key(k, b))
        return F.struct(
            name.alias("table_name"),
            F.transform(
                columns,
                lambda b: F.struct(
                    column_name(k, b).alias("column_name"),
                    b["type"].alias("data_type"),
                    F.parse_json(nullable_json(k, b)).alias("nullable"),
                ),
            ).alias("columns"),
            F.concat(
                F.transform(
                    F.filter(columns, lambda b: is_primary(k, b)),
                    lambda b: constraint(F.concat(name, F.lit("_pkey")), "PRIMARY KEY", b["c"]),
                ),
                F.flatten(F.transform(keys, key_constraints)),
            ).alias("constraints"),
            F.transform(
                keys,
                lambda b: F.struct(
                    b["child_column"].alias("child_column"),
                    parent_table(k, b).alias("parent_table"),
                    b["parent_column"].alias("parent_column"),
                ),
            ).alias("relationships"),
        )

    stub = F.array(
        F.struct(
            table_name(k, F.lit(STUB_TABLE)).alias("table_name"),
            F.lit(None).cast(OF_COLUMNS).alias("columns"),
            F.lit(None).cast(OF_CONSTRAINTS).alias("constraints"),
            F.lit(None).cast(OF_KEYS).alias("relationships"),
        )
    )
    listed = F.transform(_document_literals(), document_table)
    listed = F.when(every(k, 17), F.concat(listed, stub)).otherwise(listed)

    def view_column(name: str, data_type: str | None, nullable) -> Column:
        text = {False: "false", "YES": '"YES"', None: None}[nullable]
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(data_type).cast("string").alias("data_type"),
            F.parse_json(F.lit(text).cast("string")).alias("nullable"),
        )

    views = F.transform(
        _view_array(k, None, view_column),
        lambda v: F.struct(
            v["view_name"].alias("view_name"),
            v["definition"].alias("definition"),
            v["cols"].alias("columns"),
        ),
    )
    return cust.select(
        "database_id",
        F.when(every(k, 23, 5), F.lit("")).otherwise(F.lit("postgresql")).alias("database_type"),
        F.concat(F.lit("tenant_"), k.cast("string")).alias("schema"),
        F.when(every(k, 3), F.lit("15.0")).when(every(k, 3, 1), F.lit("")).alias("database_version"),
        F.when(every(k, 3, 1), F.lit("14.2")).alias("version"),
        F.when(has_tables(k), listed).alias("tables"),
        F.when(has_tables(k) & (F.size(views) > 0), views).alias("views"),
    )


# -------------------------------------------------------------------------- labels

LONG_TABLE_TEXT = " and used by several teams for daily reporting across all regions and markets"
LONG_COLUMN_TEXT = " with enough words to be long and specific and useful to a reader"


def _table_description(k: Column, b: Column) -> Column:
    kind = (k + b["t"]) % 4
    text = F.concat(F.lit("Rows of "), table_name(k, b["table"]), F.lit(" kept by the tenant"))
    return (
        F.when(kind == 1, F.lit("  "))
        .when((kind > 1) & ((k + b["t"]) % 3 == 0), F.concat(text, F.lit(LONG_TABLE_TEXT)))
        .when(kind > 1, text)
    )


def _business_role(k: Column, b: Column) -> Column:
    roles = F.array(*[F.lit(r) for r in ROLES])
    return F.when((k + b["t"]) % 6 != 5, F.get(roles, ((k + b["t"]) % len(ROLES)).cast("int")))


def _domain(k: Column, b: Column, segment: Column) -> Column:
    return F.when(
        (k + b["t"]) % 5 != 4,
        F.when(b["t"] % 2 == 0, segment).otherwise(F.lit("Reference Data")),
    )


def _column_description(k: Column, b: Column) -> Column:
    kind = (k + b["g"]) % 4
    text = F.concat(column_name(k, b), F.lit(" of "), table_name(k, b["table"]))
    return (
        F.when(kind == 1, F.lit(""))
        .when((kind > 1) & ((k + b["g"]) % 3 == 0), F.concat(text, F.lit(LONG_COLUMN_TEXT)))
        .when(kind > 1, text)
    )


def _model_type(k: Column, b: Column) -> Column:
    kind = (k + b["g"]) % 3
    return F.when(kind == 1, F.lit("ID")).when(kind == 2, F.lit("NAME"))


ENTITIES = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "LineItem", "Document"]
PAIRS = [
    ("Customer", "Order, LineItem", "A Customer places one or more Orders (1:N)"),
    ("Order", "Customer", "Each order belongs to exactly one Customer (N:1), by account"),
    ("LineItem", "Part", "LineItem refers to a Part via partkey"),
    ("Nation", "Region", "A Nation is located in one Region"),
    ("Region", "Nation", "each region is the parent of nations"),
]
CASES = [
    ("Revenue by region", "Sum order value per region", "orders, region"),
    ("Late parts", "", "lineitem, part, supplier"),
]
SAMPLES = [
    ("How many orders are open?", "SELECT count(*) FROM orders WHERE o_orderstatus = 'O'", "Aggregation"),
    ("List parts", "SELECT * FROM part", ""),
]


def _listed(cust: DataFrame, rows: list[tuple], names: list[str], keep=None) -> DataFrame:
    """Literal rows per database, numbered."""
    items = _structs(" ".join(names), rows)
    out = cust.filter(has_tables(F.col("database_id"))).select(
        "database_id", F.posexplode(items).alias("ordinal", "i")
    ).select("database_id", F.col("ordinal").cast("bigint").alias("ordinal"), "i.*")
    return out if keep is None else out.filter(keep)


class TenantLabels:
    """The fields of ``Labels``, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> None:
        self.customers = customers(spark, sf_dir, among)
        self.k = F.col("database_id")

    @cached_property
    def table_labels(self) -> DataFrame:
        k = self.k
        return _rows(
            self.customers,
            _table_literals(),
            lambda b: F.struct(
                table_name(k, b["table"]).alias("table_name"),
                _table_description(k, b).alias("description"),
                _business_role(k, b).alias("business_role"),
                _domain(k, b, F.col("segment")).alias("domain"),
            ),
            None,
            "segment",
        )

    @cached_property
    def column_labels(self) -> DataFrame:
        found = classify(F.col("column_name"))["classification"]
        return _column_answers(self.customers).select(
            "database_id",
            "table_name",
            "column_name",
            "description",
            F.coalesce(found, "model_type").alias("semantic_type"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        return _listed(self.customers, [(e,) for e in ENTITIES], ["name"])

    @cached_property
    def entity_relationships(self) -> DataFrame:
        has_pair = (F.col("ordinal") != 1) | (self.k % 5 != 2)
        blank = (F.col("ordinal") == 2) & every(self.k, 3)
        pairs = _listed(
            self.customers, PAIRS, ["entity", "related_entities", "business_meaning"], has_pair
        )
        return pairs.withColumn(
            "business_meaning", F.when(blank, F.lit("")).otherwise(F.col("business_meaning"))
        )

    @cached_property
    def use_cases(self) -> DataFrame:
        return _listed(self.customers, CASES, ["name", "description", "involved_tables"])

    @cached_property
    def sample_queries(self) -> DataFrame:
        return _listed(self.customers, SAMPLES, ["question", "sql", "category"])


def labels(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> TenantLabels:
    return TenantLabels(spark, sf_dir, among)


def _column_answers(cust: DataFrame) -> DataFrame:
    k = F.col("database_id")
    return _rows(
        cust,
        _all_columns(k),
        lambda b: F.struct(
            _long(F.floor(b["t"] / 10), "batch_no"),
            table_name(k, b["table"]).alias("table_name"),
            column_name(k, b).alias("column_name"),
            _column_description(k, b).alias("description"),
            _model_type(k, b).alias("model_type"),
        ),
    )


def model_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _column_answers(customers(spark, sf_dir)).select(
        "database_id", "table_name", "column_name", F.col("model_type").alias("semantic_type")
    )


def verdicts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Judgements of descriptions, by arithmetic on the place of the object."""

    def judge(df: DataFrame, kind: str, name: Column, place: str) -> DataFrame:
        return df.filter(F.col("description").isNotNull()).select(
            "database_id",
            F.lit(kind).alias("object_type"),
            name.alias("object_name"),
            ((F.col("database_id") + F.col(place)) % 3 == 0).alias("is_boilerplate"),
            F.lit("generic wording").alias("reason"),
        )

    return judge(tables, "table", F.col("table_name"), "table_ordinal").unionAll(
        judge(
            columns, "column", F.concat("table_name", F.lit("."), "column_name"), "column_ordinal"
        )
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as text, wrapped the ways models wrap JSON.

    One answer for the table pass, one per batch of 10 tables for the column
    pass, one for the schema pass.  Tenants with ``database_id % 29 = 7`` get a
    table answer that does not parse.
    """
    cust = customers(spark, sf_dir)
    k = F.col("database_id")
    lab = labels(spark, sf_dir)
    tab = lab.table_labels.groupBy("database_id").agg(
        *[
            F.map_from_entries(F.collect_list(F.when(
                F.col(c).isNotNull(), F.struct(F.col("table_name").alias("key"), F.col(c).alias("value"))
            ))).alias(out)
            for out, c in (
                ("table_descriptions", "description"),
                ("business_roles", "business_role"),
                ("domains", "domain"),
            )
        ]
    )
    body = F.to_json(F.struct("table_descriptions", "business_roles", "domains"))
    first = tab.select(
        "database_id",
        F.lit(1).alias("pass_no"),
        F.lit(0).cast("bigint").alias("batch_no"),
        F.when(every(k, 29, 7), F.concat(F.lit("Sorry, "), F.substring(body, 1, 40)))
        .when(every(k, 3), F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(every(k, 3, 1), F.concat(F.lit("Result: "), body, F.lit(" end")))
        .otherwise(body)
        .alias("answer"),
    )
    cols = _column_answers(cust)
    per_table = cols.groupBy("database_id", "batch_no", "table_name").agg(
        F.map_from_entries(F.collect_list(F.when(
            F.col("description").isNotNull(),
            F.struct(F.col("column_name").alias("key"), F.col("description").alias("value")),
        ))).alias("d"),
        F.collect_list(F.when(
            F.col("model_type").isNotNull(),
            F.struct(
                F.concat("table_name", F.lit("."), "column_name").alias("key"),
                F.col("model_type").alias("value"),
            ),
        )).alias("s"),
    )
    second = per_table.groupBy("database_id", "batch_no").agg(
        F.map_from_entries(F.collect_list(F.struct("table_name", "d"))).alias("column_descriptions"),
        F.map_from_entries(F.flatten(F.collect_list("s"))).alias("semantic_types"),
    ).select(
        "database_id",
        F.lit(2).alias("pass_no"),
        "batch_no",
        F.to_json(F.struct("column_descriptions", "semantic_types")).alias("answer"),
    )

    def listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.groupBy("database_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("i")))),
                lambda x: x["i"],
            ).alias(name)
        )

    third = cust.filter(has_tables(k)).select("database_id")
    for df in (
        listed(lab.entity_relationships, "entity_relationships", "entity", "related_entities",
               "business_meaning"),
        listed(lab.use_cases.select("database_id", "ordinal", "name", "description",
                                    F.split("involved_tables", ", ").alias("involved_tables")),
               "use_cases", "name", "description", "involved_tables"),
        listed(lab.sample_queries, "sample_queries", "question", "sql", "category"),
    ):
        third = third.join(df, "database_id", "left")
    names = F.lit(", ".join(f'"{e}"' for e in ENTITIES))
    rest = F.to_json(F.struct("entity_relationships", "use_cases", "sample_queries"))
    third = third.select(
        "database_id",
        F.lit(3).alias("pass_no"),
        F.lit(0).cast("bigint").alias("batch_no"),
        F.concat(
            F.lit('```\n{"entities": ['), names, F.lit(', 7, "Region"], '),
            F.substring(rest, 2, 1 << 30), F.lit("\n```"),
        ).alias("answer"),
    )
    return first.unionAll(second).unionAll(third)
