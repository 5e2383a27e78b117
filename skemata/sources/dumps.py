"""System catalogs of five vendors to relations.

Each vendor relation is read once, in bulk, for any number of databases (JDBC
or a dump of it), and the catalog is put together with joins.  A dump carries a
``database_id`` column next to the vendor's own columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.scale import number_rows
from skemata.schemas import Catalog

ANSI = "information_schema"

# The vendor relations each extract reads.
VENDOR_RELATIONS: dict[str, dict[str, str]] = {
    "postgres": {
        "tables": f"{ANSI}.tables",
        "columns": f"{ANSI}.columns",
        "table_constraints": f"{ANSI}.table_constraints",
        "key_column_usage": f"{ANSI}.key_column_usage",
        "constraint_column_usage": f"{ANSI}.constraint_column_usage",
        "views": f"{ANSI}.views",
    },
    "mysql": {
        "tables": f"{ANSI}.tables",
        "columns": f"{ANSI}.columns",
        "table_constraints": f"{ANSI}.table_constraints",
        "key_column_usage": f"{ANSI}.key_column_usage",
        "views": f"{ANSI}.views",
    },
    "sqlserver": {
        "tables": "INFORMATION_SCHEMA.TABLES",
        "columns": "INFORMATION_SCHEMA.COLUMNS",
        "table_constraints": "INFORMATION_SCHEMA.TABLE_CONSTRAINTS",
        "constraint_column_usage": "INFORMATION_SCHEMA.CONSTRAINT_COLUMN_USAGE",
        "views": "INFORMATION_SCHEMA.VIEWS",
        "sys_foreign_keys": "sys.foreign_keys",
        "sys_foreign_key_columns": "sys.foreign_key_columns",
        "sys_tables": "sys.tables",
        "sys_columns": "sys.columns",
    },
    "oracle": {
        "user_tables": "USER_TABLES",
        "user_tab_columns": "USER_TAB_COLUMNS",
        "user_constraints": "USER_CONSTRAINTS",
        "user_cons_columns": "USER_CONS_COLUMNS",
        "user_views": "USER_VIEWS",
    },
    "sqlite": {
        "sqlite_master": "sqlite_master",
        "table_info": "pragma_table_info",
        "foreign_key_list": "pragma_foreign_key_list",
    },
}
VENDOR_RELATIONS["mariadb"] = VENDOR_RELATIONS["mysql"]

# What each extract reports as vendor and default schema name.
REPORTED = {
    "postgres": ("postgresql", "public"),
    "mysql": ("mysql", None),
    "mariadb": ("mysql", None),
    "sqlserver": ("sqlserver", "dbo"),
    "oracle": ("oracle", None),
    "sqlite": ("sqlite", "main"),
}
KEY_TYPES = ["PRIMARY KEY", "FOREIGN KEY", "UNIQUE"]


def vendor_relations(vendor: str) -> dict[str, str]:
    if vendor not in VENDOR_RELATIONS:
        raise ValueError(f"Unsupported database type: {vendor}")
    return VENDOR_RELATIONS[vendor]


def read_vendor(
    spark: SparkSession, vendor: str, url: str, database_id: int, **options: str
) -> dict[str, DataFrame]:
    """One bulk JDBC read per vendor relation (the driver jar is the user's)."""
    return {
        name: spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .load()
        .withColumn("database_id", F.lit(database_id).cast("bigint"))
        for name, table in vendor_relations(vendor).items()
    }


def extract(
    vendor: str, relations: Mapping[str, DataFrame], schema: str | None = None
) -> Extract:
    """The relations of every database in the dumps of one vendor; nothing runs yet."""
    wanted = vendor_relations(vendor)
    missing = sorted(set(wanted) - set(relations))
    if missing:
        raise ValueError(f"missing relations for {vendor}: {', '.join(missing)}")
    lower = {
        name: df.select(*[F.col(c).alias(c.lower()) for c in df.columns])
        for name, df in relations.items()
    }
    reported, default = REPORTED[vendor]
    schema = schema or default
    pieces = _EXTRACTS[vendor](lower, schema)
    return _finish(*pieces, vendor=reported, schema=schema)


def _scoped(df: DataFrame, schema: str | None) -> DataFrame:
    return df if schema is None else df.filter(F.col("table_schema") == schema)


def _ansi_base(rel: Mapping[str, DataFrame], schema: str | None):
    tables = _scoped(rel["tables"], schema).filter(F.col("table_type") == "BASE TABLE")
    columns = _scoped(rel["columns"], schema).select(
        "database_id",
        "table_name",
        "column_name",
        "data_type",
        (F.col("is_nullable") == "YES").alias("is_nullable"),
        F.col("ordinal_position").cast("bigint").alias("place"),
    )
    views = _scoped(rel["views"], schema).select(
        "database_id",
        F.col("table_name").alias("view_name"),
        F.col("view_definition").alias("definition"),
    )
    return tables.select("database_id", "table_name"), columns, views


def _ansi_constraints(rel: Mapping[str, DataFrame], schema: str | None, same_table: bool) -> DataFrame:
    on = ["database_id", "constraint_name", "table_schema"]
    if same_table:
        on.append("table_name")
    usage = rel["key_column_usage"]
    usage = usage if same_table else usage.drop("table_name")
    return (
        _scoped(rel["table_constraints"], schema)
        .filter(F.col("constraint_type").isin(KEY_TYPES))
        .join(usage, on)
        .select(
            "database_id",
            "table_name",
            "constraint_name",
            "constraint_type",
            "column_name",
            F.col("ordinal_position").cast("bigint").alias("place"),
        )
    )


def _postgres(rel, schema):
    tables, columns, views = _ansi_base(rel, schema)
    constraints = _ansi_constraints(rel, schema, same_table=False)
    keys = constraints.filter(F.col("constraint_type") == "FOREIGN KEY")
    target = rel["constraint_column_usage"]
    target = _scoped(target, schema)
    # the key's own position pairs composite keys when the dump has it
    paired = "ordinal_position" in target.columns
    parents = target.select(
        "database_id",
        "constraint_name",
        F.col("table_name").alias("to_table"),
        F.col("column_name").alias("to_column"),
        *([F.col("ordinal_position").cast("bigint").alias("place")] if paired else []),
    )
    on = ["database_id", "constraint_name"] + (["place"] if paired else [])
    rels = keys.join(parents, on).select(
        "database_id",
        F.col("table_name").alias("from_table"),
        F.col("column_name").alias("from_column"),
        "to_table",
        "to_column",
        "constraint_name",
    )
    return tables, columns, constraints, rels, views


def _mysql(rel, schema):
    tables, columns, views = _ansi_base(rel, schema)
    rels = (
        _scoped(rel["key_column_usage"], schema)
        .filter(F.col("referenced_table_name").isNotNull())
        .select(
            "database_id",
            F.col("table_name").alias("from_table"),
            F.col("column_name").alias("from_column"),
            F.col("referenced_table_name").alias("to_table"),
            F.col("referenced_column_name").alias("to_column"),
            "constraint_name",
        )
    )
    return tables, columns, _ansi_constraints(rel, schema, same_table=True), rels, views


def _sqlserver(rel, schema):
    tables, columns, views = _ansi_base(rel, None)
    constraints = (
        rel["table_constraints"]
        .filter(F.col("constraint_type").isin(KEY_TYPES))
        .select("database_id", "table_name", "constraint_name", "constraint_type")
        .join(
            rel["constraint_column_usage"].select("database_id", "constraint_name", "column_name"),
            ["database_id", "constraint_name"],
        )
        .withColumn("place", F.lit(None).cast("bigint"))
    )

    def named(prefix: str, key: str) -> DataFrame:
        return rel["sys_tables"].select(
            "database_id", F.col("object_id").alias(key), F.col("name").alias(f"{prefix}_table")
        )

    def column(prefix: str) -> DataFrame:
        obj = "parent_object_id" if prefix == "from" else "referenced_object_id"
        col = "parent_column_id" if prefix == "from" else "referenced_column_id"
        return rel["sys_columns"].select(
            "database_id",
            F.col("object_id").alias(obj),
            F.col("column_id").alias(col),
            F.col("name").alias(f"{prefix}_column"),
        )

    rels = (
        rel["sys_foreign_keys"]
        .select(
            "database_id",
            F.col("name").alias("constraint_name"),
            F.col("object_id").alias("constraint_object_id"),
        )
        .join(
            rel["sys_foreign_key_columns"].select(
                "database_id",
                "constraint_object_id",
                "parent_object_id",
                "parent_column_id",
                "referenced_object_id",
                "referenced_column_id",
            ),
            ["database_id", "constraint_object_id"],
        )
        .join(named("from", "parent_object_id"), ["database_id", "parent_object_id"])
        .join(named("to", "referenced_object_id"), ["database_id", "referenced_object_id"])
        .join(column("from"), ["database_id", "parent_object_id", "parent_column_id"])
        .join(column("to"), ["database_id", "referenced_object_id", "referenced_column_id"])
        .select(
            "database_id", "from_table", "from_column", "to_table", "to_column", "constraint_name"
        )
    )
    return tables, columns, constraints, rels, views


def _oracle(rel, schema):
    # One-letter constraint types.
    kind = (
        F.when(F.col("constraint_type") == "P", F.lit("PRIMARY KEY"))
        .when(F.col("constraint_type") == "R", F.lit("FOREIGN KEY"))
        .otherwise(F.lit("UNIQUE"))
    )
    tables = rel["user_tables"].select("database_id", "table_name")
    columns = rel["user_tab_columns"].select(
        "database_id",
        "table_name",
        "column_name",
        "data_type",
        (F.col("nullable") == "Y").alias("is_nullable"),
        F.col("column_id").cast("bigint").alias("place"),
    )
    parts = rel["user_cons_columns"].select(
        "database_id",
        "owner",
        "constraint_name",
        "column_name",
        F.col("position").cast("bigint").alias("place"),
    )
    heads = rel["user_constraints"].filter(F.col("constraint_type").isin("P", "R", "U"))
    constraints = heads.join(
        parts.drop("owner"), ["database_id", "constraint_name"]
    ).select(
        "database_id",
        "table_name",
        "constraint_name",
        kind.alias("constraint_type"),
        "column_name",
        "place",
    )
    child = (
        heads.filter(F.col("constraint_type") == "R")
        .select(
            "database_id",
            "owner",
            "constraint_name",
            F.col("table_name").alias("from_table"),
            "r_owner",
            "r_constraint_name",
        )
        .join(
            parts.withColumnRenamed("column_name", "from_column"),
            ["database_id", "owner", "constraint_name"],
        )
    )
    parent = (
        rel["user_constraints"]
        .select("database_id", "owner", "constraint_name", F.col("table_name").alias("to_table"))
        .join(
            parts.withColumnRenamed("column_name", "to_column"),
            ["database_id", "owner", "constraint_name"],
        )
        .withColumnsRenamed({"owner": "r_owner", "constraint_name": "r_constraint_name"})
    )
    rels = child.join(parent, ["database_id", "r_owner", "r_constraint_name", "place"]).select(
        "database_id", "from_table", "from_column", "to_table", "to_column", "constraint_name"
    )
    views = rel["user_views"].select(
        "database_id", "view_name", F.col("text").alias("definition")
    )
    return tables, columns, constraints, rels, views


def _sqlite(rel, schema):
    master = rel["sqlite_master"]
    tables = master.filter(
        (F.col("type") == "table") & (F.col("name") != "sqlite_sequence")
    ).select("database_id", F.col("name").alias("table_name"))
    info = rel["table_info"]
    columns = info.select(
        "database_id",
        "table_name",
        F.col("name").alias("column_name"),
        F.col("type").alias("data_type"),
        (F.col("notnull") == 0).alias("is_nullable"),
        F.col("cid").cast("bigint").alias("place"),
    )
    constraints = info.filter(F.col("pk") > 0).select(
        "database_id",
        "table_name",
        F.concat(F.lit("pk_"), "table_name").alias("constraint_name"),
        F.lit("PRIMARY KEY").alias("constraint_type"),
        F.col("name").alias("column_name"),
        F.col("pk").cast("bigint").alias("place"),
    )
    rels = rel["foreign_key_list"].select(
        "database_id",
        F.col("table_name").alias("from_table"),
        F.col("from").alias("from_column"),
        F.col("table").alias("to_table"),
        F.col("to").alias("to_column"),
        F.lit(None).cast("string").alias("constraint_name"),
    )
    views = master.filter(F.col("type") == "view").select(
        "database_id", F.col("name").alias("view_name"), F.col("sql").alias("definition")
    )
    return tables, columns, constraints, rels, views


_EXTRACTS = {
    "postgres": _postgres,
    "mysql": _mysql,
    "mariadb": _mysql,
    "sqlserver": _sqlserver,
    "oracle": _oracle,
    "sqlite": _sqlite,
}


@dataclass(frozen=True)
class Extract:
    """The relations of a dump, keyed by names.  Making one runs no job.

    Rows carry what orders them as a struct ``order`` (tables come in name order);
    ``catalog`` turns that into dense ordinals, for those who read them.
    """

    vendor: str
    schema: str | None
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    relationships: DataFrame
    views: DataFrame
    view_columns: DataFrame

    @property
    def databases(self) -> DataFrame:
        return self.tables.select("database_id").distinct().select(
            "database_id",
            F.lit(self.vendor).alias("vendor"),
            F.lit(self.schema).cast("string").alias("name"),
            F.lit(None).cast("string").alias("version"),
        )

    def catalog(self) -> Catalog:
        """The same with dense ordinals per database, each relation sorted and checkpointed."""

        def numbered(df: DataFrame, name: str) -> DataFrame:
            rows = number_rows(df, ["database_id"], ["order"], name)
            return rows.select("database_id", name, *[c for c in df.columns if c not in ("database_id", "order")])

        tables = numbered(self.tables, "table_ordinal")
        places = tables.select("database_id", "table_name", "table_ordinal")
        columns = numbered(self.columns, "column_ordinal").join(places, ["database_id", "table_name"])
        return Catalog(
            databases=self.databases,
            tables=tables,
            columns=columns.select("database_id", "column_ordinal", "table_ordinal", *COLUMN_FIELDS),
            constraints=numbered(self.constraints, "constraint_ordinal"),
            relationships=numbered(self.relationships, "rel_ordinal"),
            views=numbered(self.views, "view_ordinal"),
            view_columns=numbered(self.view_columns, "view_column_ordinal"),
        )


COLUMN_FIELDS = ["table_name", "position", "column_name", "data_type", "is_nullable", "is_primary_key"]


def _ordered(df: DataFrame, order: Sequence[str], *fields: str | Column) -> DataFrame:
    return df.select("database_id", F.struct(*order).alias("order"), *fields)


def _finish(tables, columns, constraints, rels, views, vendor, schema) -> Extract:
    """Shared tail: key flags, and columns apart by tables and views."""
    tables = tables.distinct()
    views = views.dropDuplicates(["database_id", "view_name"])
    keys = (
        constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
        .select("database_id", "table_name", "column_name", F.lit(True).alias("pk"))
        .distinct()
    )
    of_tables = columns.join(tables.select("database_id", "table_name"), ["database_id", "table_name"], "left_semi").join(
        keys, ["database_id", "table_name", "column_name"], "left"
    )
    of_views = columns.withColumnRenamed("table_name", "view_name").join(
        views.select("database_id", "view_name"), ["database_id", "view_name"], "left_semi"
    )
    position = F.col("place").alias("position")
    return Extract(
        vendor,
        schema,
        tables=_ordered(tables, ["table_name"], "table_name", F.lit("TABLE").alias("table_type")),
        columns=_ordered(
            of_tables, ["table_name", "place", "column_name"],
            "table_name", position, "column_name", "data_type", "is_nullable",
            F.coalesce("pk", F.lit(False)).alias("is_primary_key"),
        ),
        constraints=_ordered(
            constraints, ["table_name", "constraint_name", "place", "column_name"],
            "table_name", "constraint_name", "constraint_type", "column_name",
        ),
        relationships=_ordered(
            rels, ["from_table", "from_column", "to_table", "to_column"],
            "from_table", "from_column", "to_table", "to_column", "constraint_name",
        ),
        views=_ordered(
            views, ["view_name"], "view_name", F.coalesce("definition", F.lit("")).alias("definition")
        ),
        view_columns=_ordered(
            of_views, ["view_name", "place", "column_name"],
            "view_name", position, "column_name", "data_type", "is_nullable",
        ),
    )
