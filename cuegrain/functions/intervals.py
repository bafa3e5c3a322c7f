"""Points and intervals that meet, without comparing every pair.

Intervals and points are laid in one order and the furthest end so far runs along it: a point is covered if and only if some
interval that began before it reaches past it. That takes one sort, whatever the number of intervals, and they may overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered_points(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, closed: bool, cell: float) -> DataFrame:
    """Rows of points that lie in a span of their key: start <= point < end, or <= end if closed.

    A key is cut into cells of so many units of the point; a span is dealt to the cells that it touches, and cells are windows of
    their own, so a long key is many tasks' work. The work is linear in points, spans and the cells that
    spans touch, but for sorting. Spans with a null end, and points that are null, meet nothing; a span that ends before it starts neither.
    """
    index = lambda x: F.floor(F.col(x) / F.lit(float(cell)))
    good = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    dealt = good.select(key, F.col(start).alias("__at"), F.col(end).alias("__reach"), F.explode(F.sequence(index(start), index(end))).alias("__cell"), F.lit(0).alias("__kind"))
    seen = points.where(F.col(point).isNotNull()).withColumns({"__at": F.col(point), "__cell": index(point), "__kind": F.lit(1)})
    both = seen.unionByName(dealt, allowMissingColumns=True)
    order = Window.partitionBy(key, "__cell").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__reach", F.max("__reach").over(order))
    met = F.col("__reach") >= F.col("__at") if closed else F.col("__reach") > F.col("__at")
    return both.where((F.col("__kind") == 1) & met).select(*points.columns)


def apart_from(rows: DataFrame, spans: DataFrame, key: str, start: str, end: str, span_start: str, span_end: str) -> DataFrame:
    """Rows that overlap no half-open span of their key: for no span, start < span_end and end > span_start. Spans may be infinite.

    One sort by key: a row stands at its end, after it the spans that begin there, and looks at the furthest end of the spans
    that begin before. Rows without a key, a start or an end overlap nothing.
    """
    dealt = spans.where(F.col(span_start).isNotNull() & F.col(span_end).isNotNull()).select(key, F.col(span_start).alias("__at"), F.col(span_end).alias("__reach"), F.lit(1).alias("__kind"))
    seen = rows.withColumns({"__at": F.col(end), "__kind": F.lit(0)})
    both = seen.unionByName(dealt, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__reach", F.max("__reach").over(order))
    hit = F.coalesce((F.col("__reach") > F.col(start)) & F.col("__at").isNotNull() & F.col(key).isNotNull(), F.lit(False))
    return both.where((F.col("__kind") == 0) & ~hit).select(*rows.columns)
