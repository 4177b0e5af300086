"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of each component, for nodes with an edge.

    Distributed union-find: every node points to a node of its component.  In a round the
    tree of a node is hooked to the smallest grandparent seen at its neighbours, and
    pointers are shortened by one step; the number of rounds grows with the logarithm of the longest
    path.  Rounds are aggregations of minima (combined before the shuffle, so a hub is no
    hot spot) and joins that Spark may split; each is written to the shared folder.

    Null ends and loops are no edges; repeated edges count once; no edges, no rows.
    """
    both = edges.where("a <> b").select("a", "b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n"))
    parents = stored(parents.select("node", F.least("node", "n").alias("up")), "parents")
    while True:
        above = parents.select(F.col("node").alias("k"), F.col("up").alias("top"))
        held = stored(parents.join(above, F.col("up") == F.col("k")).select("node", "up", "top"), "held")
        seen = both.join(held.select(F.col("node").alias("k"), "top"), F.col("b") == F.col("k"))
        seen = seen.groupBy(F.col("a").alias("node")).agg(F.min("top").alias("least"))
        near = held.join(seen, "node")
        offers = near.select(
            F.explode(
                F.array(
                    F.struct("node", F.least("up", "top", "least").alias("up")),
                    F.struct(F.col("up").alias("node"), F.col("least").alias("up")),
                )
            ).alias("o")
        )
        after = stored(offers.groupBy("o.node").agg(F.min("o.up").alias("up")).select("node", "up"), "parents")
        # a root may be offered a larger node; it keeps pointing to itself or lower
        after = after.select("node", F.least("node", "up").alias("up"))
        changed = after.join(held.select("node", F.col("up").alias("old"), "top"), "node").where(
            (F.col("up") != F.col("old")) | (F.col("top") != F.col("old"))
        )
        parents = after
        if changed.isEmpty():
            return parents.select("node", F.col("up").alias("root"))
