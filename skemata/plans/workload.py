"""The relational queries users of a catalog run, over the star-schema tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.functions.sqltext import table_refs

Tables = Mapping[str, DataFrame]

# date the interval question is asked on
REFERENCE_DATE = "1998-01-01"


def order_places(t: Tables) -> DataFrame:
    """Three left joins in a row: order to customer, nation and region."""
    return (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


def finished_orders(t: Tables) -> DataFrame:
    """Inner join and an equality filter."""
    return (
        t["orders"]
        .filter(F.col("o_orderstatus") == "F")
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name", "o_orderdate", "o_totalprice", "o_orderstatus")
    )


def customer_activity(t: Tables) -> DataFrame:
    """Left joins to a dimension and to an event table."""
    return (
        t["customer"]
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "c_name", "n_name", "c_mktsegment", "o_orderdate", "o_orderstatus")
    )


def order_tracking(t: Tables) -> DataFrame:
    """An inner join, then a left join."""
    return (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select("o_orderkey", "c_name", "o_orderstatus", "l_linenumber", "l_shipdate")
    )


def line_details(t: Tables) -> DataFrame:
    """Two inner joins."""
    return (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_linenumber", "o_orderdate", "p_name", "p_brand", "l_quantity")
    )


def orders_of_segment(t: Tables, segment: str = "BUILDING") -> DataFrame:
    """All columns of one side after a join and a filter on the other."""
    inside = t["customer"].filter(F.col("c_mktsegment") == segment)
    return (
        t["orders"]
        .alias("o")
        .join(inside, F.col("o_custkey") == F.col("c_custkey"))
        .select("o.*")
    )


def parts_of_type(t: Tables, kind: str = "ECONOMY") -> DataFrame:
    """One table, one filter."""
    return t["part"].filter(F.col("p_type") == kind).select("p_partkey", "p_name", "p_type")


def order_counts(t: Tables) -> DataFrame:
    """Orders per customer, zero included.

    Orders are counted before the join: a customer with a third of all orders
    crosses the network as one row per task.
    """
    counts = t["orders"].groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (
        t["customer"]
        .join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("order_count"))
    )


def orders_due(t: Tables, day: str = REFERENCE_DATE, days: int = 7) -> DataFrame:
    """Dates up to some days after a given day, which is a parameter so results repeat."""
    bound = F.to_timestamp(F.lit(day)) + F.expr(f"INTERVAL {int(days)} DAYS")
    return t["orders"].filter(F.col("o_orderdate") <= bound).select("o_orderkey", "o_orderdate")


KPIS = [
    ("Open orders", "SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'O'"),
    ("Revenue", "SELECT sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem"),
    ("Parts sold", "SELECT count(DISTINCT l_partkey) AS value FROM lineitem JOIN part ON l_partkey = p_partkey"),
    ("Phantom", "SELECT count(*) AS value FROM ghost_ledger"),
]


def kpi_values(t: Tables, kpis: Sequence[tuple[str, str]] = KPIS) -> DataFrame:
    """KPI statements over registered views; those naming unknown tables do not run.

    The statements are user text, a short list, checked like any grounded item.
    """
    spark = next(iter(t.values())).sparkSession
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    rows = spark.createDataFrame(list(kpis), "kpi string, sql string")
    refs = rows.select("kpi", table_refs(F.col("sql")).alias("refs")).collect()
    grounded = {r["kpi"] for r in refs if set(r["refs"]) <= set(t)}
    out = None
    for kpi, sql in kpis:
        if kpi in grounded:
            one = spark.sql(sql).select(
                F.lit(kpi).alias("kpi"), F.col("value").cast("double").alias("value")
            )
            out = one if out is None else out.unionAll(one)
    return out
