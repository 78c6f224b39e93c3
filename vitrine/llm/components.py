"""Connected components of a stored edge table by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stored


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it (or to itself)."""
    both = edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")
    return rest.unionByName(least.selectExpr("m as a", "a as b")).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Self-links, repeated links and nulls change nothing; an empty table gives no row. Each round is stored below
    the shared folder, so no lineage grows; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
    edges, seen = stored(edges, label), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen = state
        edges = stored(_small(_large(edges)), label)
