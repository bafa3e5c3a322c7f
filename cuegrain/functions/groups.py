"""Connected groups of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.functions.scratch import cut


def connected_groups(links: DataFrame) -> DataFrame:
    """(node, group) for every node of links (a, b); group is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so
    the number of rounds grows with the logarithm of the longest path. Rounds are written tables.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both, "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("group")), "groups")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("group").alias("near"))
        nearer = labels.join(near, labels.node == near.a).select("node", F.col("group").alias("before"), F.least("group", "near").alias("near"))
        up = labels.select(F.col("node").alias("up_node"), F.col("group").alias("up"))
        moved = nearer.join(up, F.col("near") == F.col("up_node"), "left").select("node", "before", F.least("near", F.coalesce("up", "near")).alias("group"))
        moved = cut(moved, "groups")
        labels = moved.select("node", "group")
        if moved.where("group <> before").isEmpty():
            return labels
