"""Patches: projection of components on their plane, depth layers, depth filters, lost points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import on_axis, plane_axis, round_up
from .neighbors import around

#: Depth steps of the plane position, the widest distance from a block's peak, the deepest stored depth.
PLANE_STEP, PEAK_DISTANCE, DEEPEST = 64, 32, 255


def projected(points: DataFrame) -> DataFrame:
    """points(…, x, y, z, ppi) with u, v, d (tangent, bitangent and normal coordinate) and mode."""
    axis = lambda role: on_axis(plane_axis(F.col("ppi"), role), F.col("x"), F.col("y"), F.col("z"))
    return points.withColumns({"u": axis(1), "v": axis(2), "d": axis(0), "mode": plane_axis(F.col("ppi"), 3)})


def nearness() -> Column:
    """Depth as seen from the projection plane: smaller is nearer in either mode."""
    return F.when(F.col("mode") == 1, -F.col("d")).otherwise(F.col("d"))


def bounding_boxes(pixels: DataFrame, patch: list[str]) -> DataFrame:
    return pixels.groupBy(*patch).agg(*(f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))))


def in_blocks(pixels: DataFrame, boxes: DataFrame, patch: list[str], block: int) -> DataFrame:
    """pixels with bu and bv: their block, counted from the corner of their patch's box."""
    corner = boxes.select(*patch, "min_u", "min_v")
    return pixels.join(corner, patch).withColumns({"bu": F.expr(f"(u - min_u) div {block}"), "bv": F.expr(f"(v - min_v) div {block}")}).drop("min_u", "min_v")


def block_peaks(pixels: DataFrame, patch: list[str], block: int) -> DataFrame:
    """(patch, bu, bv, peak): the nearest depth of each block, as seen from the plane."""
    keyed = in_blocks(pixels, bounding_boxes(pixels, patch), patch, block)
    return keyed.groupBy(*patch, "mode", "bu", "bv").agg(F.min(nearness()).alias("near")).withColumn("peak", F.abs("near")).drop("near")


def planes(peaks: DataFrame, patch: list[str]) -> DataFrame:
    """(patch, min_d): where the projection plane stands, a multiple of PLANE_STEP outside all peaks."""
    low, high = F.expr(f"low div {PLANE_STEP} * {PLANE_STEP}"), round_up(F.col("high"), PLANE_STEP)
    ends = peaks.groupBy(*patch, "mode").agg(F.min("peak").alias("low"), F.max("peak").alias("high"))
    return ends.withColumn("min_d", F.when(F.col("mode") == 1, high).otherwise(low)).drop("low", "high")


def near_layer(pixels: DataFrame, patch: list[str]) -> DataFrame:
    """(patch, u, v, d1, idx1): the nearest point of each pixel; ties to the smaller pt_idx."""
    least = F.min(F.struct(nearness().alias("near"), "pt_idx")).alias("m")
    return pixels.groupBy(*patch, "u", "v").agg(least, F.first("mode").alias("mode")).select(*patch, "u", "v", F.abs("m.near").alias("d1"), F.col("m.pt_idx").alias("idx1"), "mode")


def far_layer(pixels: DataFrame, near: DataFrame, patch: list[str], thickness: int = 4) -> DataFrame:
    """(patch, u, v, d2, idx2): the farthest point at most `thickness` behind the near layer; where there is none, the near one."""
    behind = F.abs(F.col("d") - F.col("d1"))
    joined = pixels.drop("mode").join(near, [*patch, "u", "v"]).withColumn("behind", behind)
    best = F.max(F.when(F.col("behind") <= thickness, F.struct("behind", (-F.col("pt_idx")).alias("neg"), "d"))).alias("m")
    return joined.groupBy(*patch, "u", "v").agg(best, F.first("d1").alias("d1"), F.first("idx1").alias("idx1")).select(*patch, "u", "v", F.col("m.d").alias("d2"), F.when(F.col("m.behind") == 0, F.col("idx1")).otherwise(-F.col("m.neg")).alias("idx2"))


def layer_fate(pixels: DataFrame, near: DataFrame, patch: list[str], thickness: int = 4, double: bool = True) -> DataFrame:
    """Points with `fate`: near, far, dropped or again (they re-enter the next round), by their distance behind the near layer."""
    joined = pixels.drop("mode").join(near, [*patch, "u", "v"]).withColumn("behind", F.abs(F.col("d") - F.col("d1")))
    if double:
        fate = F.when(F.col("behind") == 0, "near").when(F.col("behind") <= thickness, "far").when(F.col("behind") <= thickness + 1, "dropped").otherwise("again")
    else:
        fate = F.when(F.col("behind") == 0, "near").when(F.col("behind") < thickness, "dropped").otherwise("again")
    return joined.withColumn("fate", fate)


def within_depth(near: DataFrame, planes_: DataFrame, patch: list[str], thickness: int = 4) -> DataFrame:
    """Pixels of the near layer whose depth, with the far layer's thickness, still fits in eight bits."""
    relative = F.when(F.col("mode") == 1, F.col("min_d") - F.col("d1")).otherwise(F.col("d1") - F.col("min_d"))
    return near.join(planes_.drop("mode"), patch).filter(relative <= DEEPEST - thickness)


def near_their_peak(near: DataFrame, peaks: DataFrame, boxes: DataFrame, patch: list[str], block: int, most: int = PEAK_DISTANCE) -> DataFrame:
    """Pixels of the near layer at most `most` from the peak of their block; all points of the others go to the next round."""
    keyed = in_blocks(near, boxes, patch, block)
    return keyed.join(peaks.drop("mode"), [*patch, "bu", "bv"]).filter(F.abs(F.col("d1") - F.col("peak")) <= most)


def covered(points: DataFrame, kept: DataFrame, most: int = 5, anti: bool = False) -> DataFrame:
    """Points with (or, anti, without) a point of kept(frame_id, pt_idx) within squared distance `most`, other than themselves."""
    there = points.join(kept.select("frame_id", "pt_idx"), ["frame_id", "pt_idx"], "left_semi")
    return points.join(around(there, most), ["frame_id", "x", "y", "z"], "left_anti" if anti else "left_semi")


def lost(points: DataFrame, *layers: DataFrame) -> DataFrame:
    """Points that are in none of the layers(frame_id, pt_idx)."""
    for layer in layers:
        points = points.join(layer, ["frame_id", "pt_idx"], "left_anti")
    return points


def by_size(boxes: DataFrame, patch_id: str, group: list[str]) -> DataFrame:
    """Patches numbered by their longer side, largest first; ties by id."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.greatest("w", "h").desc(), patch_id)))
