"""Frames: paths, groups, statistics, unit sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ceil_log2


def paths(spark: SparkSession, pattern: str, start: int, count: int, loops: int = 1) -> DataFrame:
    """(frame_id, path): frame ids go on over the loops, file numbers begin anew in each."""
    return spark.range(count * loops).select(F.col("id").cast("int").alias("frame_id"), F.format_string(pattern, (F.lit(start) + F.col("id") % count).cast("int")).alias("path"))


def from_name(path: Column) -> Column:
    """Voxel size, frame count and first frame that a file pattern tells; 0 where it doesn't."""
    number = lambda p: F.coalesce(F.regexp_extract(path, p, 1).try_cast("int"), F.lit(0))
    return F.struct(number(r"vox([0-9]+)").alias("voxel"), number(r"([0-9]+)_%").alias("frames"), number(r"([0-9]+)_[0-9]+_%").alias("start"))


def grouped(frames: DataFrame, size: int) -> DataFrame:
    return frames.withColumns({"gof_id": F.expr(f"frame_id div {size}"), "place": F.col("frame_id") % size})


def statistics(points: DataFrame, by: list[str]) -> DataFrame:
    """Counters of points by frame (and iteration): points, planes in use, points of each plane."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.count_distinct("ppi").alias("planes"), *(F.count_if(F.col("ppi") == k).alias(f"plane{k}") for k in range(6)))


def precision_bytes(largest: Column) -> Column:
    """Bytes that a size field needs for the largest unit, 1 to 8."""
    return F.least(F.greatest(F.ceil(ceil_log2(largest) / 8), F.lit(1)), F.lit(8)).cast("int")


def offsets(units: DataFrame, by: list[str], order: str, size: str, header: int) -> DataFrame:
    """Units with the byte at which each begins, every one behind a size field of `header` bytes."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("offset", F.coalesce(F.sum(F.col(size) + header).over(before), F.lit(0)) + header)
