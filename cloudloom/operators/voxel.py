"""Voxels: range filter, voxel ids, plane histograms, majority and class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import argmax_first

PLANES = 6


def in_range(points: DataFrame, depth: int) -> DataFrame:
    """Points whose coordinates all lie below 2 ** depth."""
    return points.filter(" and ".join(f"shiftright({c}, {depth}) = 0" for c in "xyz"))


def with_voxel(points: DataFrame, shift: int) -> DataFrame:
    return points.withColumns({f"v{c}": F.shiftright(c, shift) for c in "xyz"})


def voxelize(points: DataFrame, shift: int) -> DataFrame:
    """(frame_id, vox_id, vx, vy, vz, first_idx): distinct voxels, numbered in the order of their first point."""
    voxels = with_voxel(points, shift).groupBy("frame_id", "vx", "vy", "vz").agg(F.min("pt_idx").alias("first_idx"))
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy("first_idx")) - 1
    return voxels.withColumn("vox_id", number)


def devoxelize(points: DataFrame, voxels: DataFrame, shift: int) -> DataFrame:
    """Points with the columns of their voxel."""
    return with_voxel(points, shift).join(voxels, ["frame_id", "vx", "vy", "vz"])


def histogram(points: DataFrame, shift: int) -> DataFrame:
    """(frame_id, vx, vy, vz, n, s0..s5): points of each voxel, in all and by plane."""
    counts = [F.count_if(F.col("ppi") == k).alias(f"s{k}") for k in range(PLANES)]
    return with_voxel(points, shift).groupBy("frame_id", "vx", "vy", "vz").agg(F.count("*").alias("n"), *counts)


def majority(histograms: DataFrame) -> DataFrame:
    """Histograms with ppi, their first largest plane."""
    return histograms.withColumn("ppi", argmax_first(F.array(*(f"s{k}" for k in range(PLANES)))))


def classify(histograms: DataFrame) -> DataFrame:
    """Histograms with vox_class: S (one point), NO_EDGE (one plane) or M."""
    planes = sum((F.col(f"s{k}") > 0).cast("int") for k in range(PLANES))
    return histograms.withColumn("vox_class", F.when(F.col("n") == 1, "S").when(planes == 1, "NO_EDGE").otherwise("M"))
