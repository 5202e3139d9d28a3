"""Connected components by alternating large and small stars, each a few narrow Spark joins."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from chatlens.session import materialise


def _large_star(edges):
    """Every larger neighbour of u points to the smallest node of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges):
    """u and its smaller neighbours point to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _written(edges):
    """The edges in the shared folder, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    copy = materialise(edges.observe(
        seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38)")).alias("hashes")), "edges")
    return copy, seen.get


def connected_components(edges):
    """(node, root) of every node that has an edge (u, v); root is the smallest node of its component.

    Each round is written to the shared folder, which cuts the lineage.
    """
    edges, state = _written(edges.filter("u <> v").select("u", "v").distinct())
    while state["n"]:
        before = state
        edges, state = _written(_small_star(_large_star(edges).distinct()))
        if state == before:
            break
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return down.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def extended_components(roots, edges):
    """(node, root) with further edges: `roots` are stars, so that few rounds follow; none without edges."""
    if edges.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges))
