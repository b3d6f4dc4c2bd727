"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "least").alias("least"))
    tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), "a")
    tied = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        joined.select("a", F.col("least").alias("b"))
    )
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b; long): label is the least node reachable.

    Edges only ever get redirected towards the least neighbour, so a round moves at most twice the
    edges and a node of high degree is met by partial aggregation and by run-time splitting of the
    join, never gathered. Each round is written to the shared folder; rounds grow with the logarithm
    of the longest path. Null ends and loops are ignored; an empty table gives an empty one.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("a") % 1000003)).first()
        if state == seen:
            break
        state = seen
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
