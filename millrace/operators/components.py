"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workspace import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable. ``edges`` has columns u and v.

    Every round hangs larger neighbours on the least one and is written to shared storage; the
    rounds needed grow with the logarithm of the longest chain. A round's tables are deleted when the next is written.
    """
    tree = edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    tree = materialize(tree, "edges")
    while True:
        # done when every node hangs on one root, and no root hangs on another
        ends = tree.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.unionByName(tree.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if ends.where("below > 1 OR (below = 1 AND above = 1)").agg(F.count("*")).first()[0] == 0:
            return tree.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        last, large = tree, materialize(large, "edges")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = materialize(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(last)
        discard(large)
