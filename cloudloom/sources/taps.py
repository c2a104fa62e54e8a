"""Looks into a run: clouds and images of its stages, coloured so that planes and patches can be told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.maps import borders


def colour(number: Column) -> list[Column]:
    """r, g, b of a number: hues a golden angle apart, so that numbers in turn look different."""
    hue = (number * 0.618033988749895) % 1
    channel = lambda shift: F.floor(F.lit(95) + 160 * F.least(F.greatest(F.abs((hue + shift) % 1 * 6 - 3) - 1, F.lit(0.0)), F.lit(1.0))).cast("int")
    return [channel(s).alias(c) for s, c in ((0.0, "r"), (2 / 3, "g"), (1 / 3, "b"))]


def by_plane(points: DataFrame) -> DataFrame:
    """Points of a stage in the colour of their plane, ready to be written as PLY."""
    return points.select("frame_id", "pt_idx", "x", "y", "z", *colour(F.col("ppi")))


def by_patch(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """The points of both layers in the colour of their patch."""
    layers = pixels.select("frame_id", "patch_id", F.col("idx1").alias("pt_idx")).union(pixels.select("frame_id", "patch_id", "idx2"))
    own = layers.groupBy("frame_id", "pt_idx").agg(F.min("patch_id").alias("patch_id"))
    return points.join(own, ["frame_id", "pt_idx"]).select("frame_id", "pt_idx", "x", "y", "z", *colour(F.col("patch_id")))


def taps(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Of the tables of a run: clouds by plane and patch, points in no layer, patch borders, images of all maps."""
    points, pixels = tables["points"], tables["pixels"]
    kept = pixels.select("frame_id", F.col("idx1").alias("pt_idx")).union(pixels.select("frame_id", "idx2")).distinct()
    images = tables["images"]
    of = lambda name: images.filter(F.col("map") == name)
    return {
        "planes": by_plane(points),
        "patches": by_patch(pixels, points),
        "lost": points.join(kept, ["frame_id", "pt_idx"], "left_anti").select("frame_id", "pt_idx", "x", "y", "z", "r", "g", "b"),
        "borders": borders(pixels, ["frame_id", "patch_id"]),
        "occupancy": of("occupancy"),
        "geometry": of("geometry"),
        "attribute": of("attribute"),
    }
