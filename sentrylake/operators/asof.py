"""As-of joins: each point gets the newest mark at or before it, by merging along a sequence.

Marks and points meet within ranges of the sequence by equality, and a range
without an earlier mark takes the newest of the ranges before. The ranges of a
group are one row each; only those are ordered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, marks: DataFrame, by: list[str], at: str, value: Column, width: int = 1 << 12) -> DataFrame:
    """The points with ``mark``: the value of the last mark with the same ``by`` at or before theirs, or null.

    Both have the columns ``by`` and ``at`` (a whole number). Of marks at one
    place the largest value counts. Null groups meet; points without a place get
    no mark, marks without one are left out.
    """
    group = F.struct(*by) if by else F.lit(0)
    kept = F.struct(*points.columns)
    rows = points.select(group.alias("g"), F.col(at).cast("long").alias("at"), kept.alias("p"), F.lit(True).alias("asks"))
    given = marks.where(F.col(at).isNotNull()).select(group.alias("g"), F.col(at).cast("long").alias("at"), value.alias("mark"))
    both = rows.unionByName(given, allowMissingColumns=True).withColumn("range", F.floor(F.col("at") / width))
    newest = both.groupBy("g", "range").agg(F.max(F.when(F.col("mark").isNotNull(), F.struct("at", "mark"))).alias("m"))
    earlier = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(F.col("g").alias("of"), F.col("range").alias("in"), F.last("m", ignorenulls=True).over(earlier)["mark"].alias("carried"))
    so_far = Window.partitionBy("g", "range").orderBy("at", F.col("asks").isNotNull(), "mark").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("found", F.last("mark", ignorenulls=True).over(so_far)).where("asks")
    same = F.col("g").eqNullSafe(F.col("of")) & F.col("range").eqNullSafe(F.col("in"))
    mark = F.when(F.col("at").isNotNull(), F.coalesce("found", "carried")).alias("mark")
    return within.join(carried, same).select("p.*", mark)
