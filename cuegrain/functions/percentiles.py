"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.scratch import cut


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n, least, most and a column for each of shares): percentiles of the values of a key, linear between neighbours.

    Equal values are counted first, which shrinks a value that very many rows have to one; the counted values are then laid out in ranges of (key, value), so a
    key with many values is many tasks' work, and each range's place among its key's values is the sum of the counts of the ranges before.
    What is wanted are the values at two ranks a share. Nulls are left out, and a key without values has no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("__x")).agg(F.count("*").alias("__n"))
    laid = cut(counted.repartitionByRange(key, "__x").withColumn("__part", F.spark_partition_id()), "percentiles")
    parts = laid.groupBy(key, "__part").agg(F.sum("__n").alias("__sum"))
    order = Window.partitionBy(key).orderBy("__part")
    parts = parts.select(key, "__part", (F.sum("__sum").over(order) - F.col("__sum")).alias("__before"), F.sum("__sum").over(Window.partitionBy(key)).alias("n"))
    inside = Window.partitionBy(key, "__part").orderBy("__x")
    ranked = laid.withColumn("__upto", F.sum("__n").over(inside)).join(parts, [key, "__part"])
    last = F.col("__before") + F.col("__upto") - 1  # the highest rank, from 0, that the value has
    wanted = {}
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(share)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            wanted[f"__{name}_{side}"] = F.max(F.when((rank <= last) & (rank > last - F.col("__n")), F.col("__x")))
    found = ranked.groupBy(key).agg(F.max("n").alias("n"), F.min("__x").alias("least"), F.max("__x").alias("most"), *[v.alias(k) for k, v in wanted.items()])

    def between(name: str, share: float):
        place = (F.col("n") - 1) * F.lit(share)
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name)

    return found.select(key, "n", "least", "most", *[between(name, share) for name, share in shares.items()])
