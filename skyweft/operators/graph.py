"""Connected components of an edge table by alternating large-star and
small-star contraction (Kiveris et al., 2014): every step is a grouped minimum
and a join, and the edge set shrinks towards stars around the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from ..plans.skew import salted_join


def _rewire(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step. Grouped minima combine on the map side; joining them back
    has a unique right side and is salted for nodes with very many edges."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # from each node to its smaller neighbours
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = salted_join(both, lowest, ["u"], "inner")
    if larger_only:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge table (u, v); the root
    is the smallest node of the component."""
    edges = cut_lineage(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        edges = cut_lineage(_rewire(edges, True), "edges", supersedes=edges)
        edges = cut_lineage(_rewire(edges, False), "edges", supersedes=edges)
        # Converged when the edge multiset stops changing.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
