"""Connected components of a graph of links, by alternating large-star and small-star steps.

Nulls: a link with a null on one side is none. Ties can't arise, repeated links count once, and no links give no rows. Columns
besides a and b are ignored.

Every step is a minimum per node and a join, so that no task needs a node's whole neighbourhood; the edges of a step are
written to the shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): for every node of a link the smallest node that links reach."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        if _stars(edges):
            break
    # all edges now end in their component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node or only edges to larger ones: further steps change nothing then."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.max(F.col("down") + F.col("up"))).first()[0] in (None, 1)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(smallest.select("u", F.col("m").alias("v"))).distinct()
