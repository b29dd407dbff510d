"""Connected components of an edge table, by alternating large and small stars.

Every round is a join and an aggregate over the edges; nothing but counts comes
to the driver.  The number of rounds grows with the logarithm of the longest
path.  Rounds are written to the shared folder, and so are each node's least
neighbours before the join: a node with a large share of all edges is then a
skewed partition of a plain join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links the neighbours on one side of it (and itself) to its least neighbour; the result is written."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = materialise(least.select("a", F.least("a", "m").alias("m")))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialise(out.where("a != b").distinct())
    drop(least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component.  ``drop`` deletes what it reads."""
    edges = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct())
    before = None
    while True:
        large = _star(edges, True)
        small = _star(large, False)
        drop(edges, large)
        edges = small
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if now == before:
            break
        before = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._stored_at = edges._stored_at
    return out
