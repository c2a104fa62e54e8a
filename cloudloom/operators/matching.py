"""Patches of consecutive frames: matching candidates, chains, union sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rectangle_iou


def candidates(patches: DataFrame, gof_size: int, threshold: float) -> DataFrame:
    """patches(frame_id, patch_id, ppi, x, y, w, h): pairs (frame_id, patch_id, previous_id, iou) of one axis, in consecutive frames of one group, over the threshold."""
    now = patches.withColumn("axis", F.col("ppi") % 3)
    before = now.select((F.col("frame_id") + 1).alias("frame_id"), "axis", F.col("patch_id").alias("previous_id"), *(F.col(c).alias(f"p{c}") for c in "xywh"))
    pairs = now.filter(F.col("frame_id") % gof_size != 0).join(before, ["frame_id", "axis"])
    iou = rectangle_iou(*(F.col(c) for c in "xywh"), *(F.col(f"p{c}") for c in "xywh"))
    return pairs.select("frame_id", "patch_id", "previous_id", iou.alias("iou")).filter(F.col("iou") > F.lit(threshold).cast("float"))


def best_of_each(pairs: DataFrame) -> DataFrame:
    """The candidate with the largest overlap for each previous patch; ties to the smaller patch_id."""
    order = Window.partitionBy("frame_id", "previous_id").orderBy(F.col("iou").desc(), "patch_id")
    return pairs.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def unions(links: DataFrame, patches: DataFrame, gof_size: int) -> DataFrame:
    """(gof_id, union_id, frames, w, h) of chains of links(frame_id, patch_id, previous_id), at most gof_size frames long.

    A chain is named by its first patch, frame_id * 2**20 + patch_id; its size is the largest of its patches.
    """
    node = lambda f, p: f.cast("long") * 2**20 + p.cast("long")
    up = links.select(node(F.col("frame_id"), F.col("patch_id")).alias("me"), node(F.col("frame_id") - 1, F.col("previous_id")).alias("up"))
    rows = patches.withColumn("me", node(F.col("frame_id"), F.col("patch_id"))).withColumn("union_id", F.col("me"))
    for _ in range(max(1, (gof_size - 1).bit_length())):  # pointers double: a chain has at most gof_size patches
        step = up.select(F.col("me").alias("union_id"), F.col("up").alias("next"))
        rows = rows.join(step, "union_id", "left").withColumn("union_id", F.coalesce("next", "union_id")).drop("next")
        up = up.join(up.select(F.col("me").alias("up"), F.col("up").alias("far")), "up", "left").select("me", F.coalesce("far", "up").alias("up"))
    return rows.groupBy(F.expr(f"frame_id div {gof_size}").alias("gof_id"), "union_id").agg(F.count("*").alias("frames"), F.max("w").alias("w"), F.max("h").alias("h")).filter("frames > 1")
