"""Connected components by repeated contraction, all in joins and partial aggregates.

In each round every vertex takes the smallest of itself and its neighbours as its
parent, and edges are redrawn between parents.  A round is two aggregates with
map-side combination and joins on vertices, so a hub with many edges is never
gathered.  Edges vanish after few rounds; each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex of an edge.

    ``edges`` has two columns of one orderable type.  Loops and repeats are fine;
    a null end drops the edge; no edges give no rows.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    left = written(
        pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = None
    while n := left.count():
        parents = written(
            left.groupBy("a").agg(F.min("b").alias("low"))
            .select(F.col("a").alias("vertex"), F.least("a", "low").alias("parent")),
            "parents",
            n,
        )
        if labels is None:
            labels = parents.select("vertex", F.col("parent").alias("component"))
        else:
            labels = (
                labels.join(
                    parents.withColumnRenamed("vertex", "component"), "component", "left"
                )
                .select("vertex", F.coalesce("parent", "component").alias("component"))
            )
        ends = left.filter("a < b")
        for end in ("a", "b"):
            ends = ends.join(
                parents.select(F.col("vertex").alias(end), F.col("parent").alias(f"{end}_parent")),
                end,
            )
        ends = ends.select(F.col("a_parent").alias("a"), F.col("b_parent").alias("b")).filter("a != b")
        left = written(
            ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
            "edges",
            n,
        )
    return left.toDF("vertex", "component") if labels is None else labels
