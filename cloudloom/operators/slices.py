"""Slices of a cloud across an axis: levels, votes of the axes, inherited planes, gaps in ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels(points: DataFrame) -> DataFrame:
    """(frame_id, axis, level, pt_idx, a, b, place): each point in its slice across each axis, ordered within it.

    a and b: y and z across x, x and z across y, y and x across z; with them a chain that keeps to the right of its steps faces outwards.
    """
    rows = None
    for axis, (n, a, b) in enumerate(("xyz", "yxz", "zyx")):
        own = points.select("frame_id", F.lit(axis).alias("axis"), F.col(n).alias("level"), "pt_idx", F.col(a).alias("a"), F.col(b).alias("b"))
        rows = own if rows is None else rows.unionByName(own)
    order = Window.partitionBy("frame_id", "axis", "level").orderBy("a", "b", "pt_idx")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def voted(x: Column, y: Column, z: Column) -> Column:
    """Plane of a point from those found in the slices across the three axes (nulls: none found).

    Two or three that agree decide; three that differ leave it to y; one alone, or two that differ, decide nothing.
    """
    agreed = F.when(x == y, x).when(x == z, x).when(y == z, y)
    three = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return F.when(agreed.isNotNull(), agreed).when(three, y)


def has_normal(x: Column, y: Column, z: Column) -> Column:
    """Whether at least two axes agree, which counts as a normal."""
    return F.coalesce((x == y) | (x == z) | (y == z), F.lit(False))


def inherited(points: DataFrame) -> DataFrame:
    """points(frame_id, pt_idx, ppi, parent_x, parent_y, parent_z): a point without a plane takes that of its parent in y, else x, else z."""
    known = points.filter("ppi is not null").select("frame_id", "pt_idx", "ppi")
    for axis in "yxz":
        points = points.join(known.select("frame_id", F.col("pt_idx").alias(f"parent_{axis}"), F.col("ppi").alias(f"from_{axis}")), ["frame_id", f"parent_{axis}"], "left")
    return points.withColumn("ppi", F.coalesce("ppi", "from_y", "from_x", "from_z")).drop("from_x", "from_y", "from_z")


def gaps_filled(rows: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """Ordered rows with gaps (null values) filled from both sides.

    Between equal values a gap takes that value; else its first len div 2 + 1 rows take the left one, the others
    the right one. A gap at either end has but one side.
    """
    order = Window.partitionBy(*by).orderBy(place)
    # a frame that grows from the first row on is kept up row by row; the first value to the right is the last one of the reverse order
    left = order.rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(*by).orderBy(F.col(place).desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col(value).isNotNull(), F.col(place))
    marked = rows.withColumns({"_l": F.last(value, True).over(left), "_lp": F.last(here, True).over(left)})
    marked = marked.withColumns({"_r": F.last(value, True).over(right), "_rp": F.last(here, True).over(right)})
    near = F.col(place) - F.col("_lp") <= F.expr("(_rp - _lp - 1) div 2") + 1
    return marked.withColumn(value, F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull() | near, F.col("_l")).otherwise(F.col("_r"))).drop("_l", "_r", "_lp", "_rp")
