"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.llm.common import cut, meet_totals, slices_of


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("low", "high") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (low < high); component is the smallest node reached.

    Each step replaces links by links to the smallest neighbour, which keeps what is connected and
    ends with one star per component. Every step is a grouped minimum and a join in which the neighbours
    of a hub are dealt to several tasks, so no component is gathered in one place; the number of steps grows with the logarithm of the longest path.
    """
    links = cut(links.select("low", "high").distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.min("high").alias("m"), slices_of("high").alias("slices")).withColumn("m", F.least("m", "low"))
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        large = meet_totals(both.where("high > low"), least, "low", "high").select(F.col("m").alias("low"), "high").where("low < high")
        # small star: the smaller neighbours of a node, and the node itself, go to the smallest of them
        small = large.groupBy("high").agg(F.min("low").alias("m"), slices_of("low").alias("slices"))
        moved = meet_totals(large, small, "high", "low").select("m", F.col("low").alias("other")).where("m < other")
        links = cut(moved.union(small.select("m", "high")).toDF("low", "high").distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    tops = links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).union(tops)
