"""Maps: patch pixels on the atlas, occupancy blocks, colour conversion, row fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_up


def on_map(pixels: DataFrame, patches: DataFrame, patch: list[str]) -> DataFrame:
    """pixels(patch, u, v, …) at x, y of the map; patches(patch, pos_x, pos_y, min_u, min_v, swapped)."""
    placed = pixels.join(patches.select(*patch, "pos_x", "pos_y", "min_u", "min_v", "swapped"), patch)
    du, dv = F.col("u") - F.col("min_u"), F.col("v") - F.col("min_v")
    return placed.withColumns({"x": F.col("pos_x") + F.when(F.col("swapped"), dv).otherwise(du), "y": F.col("pos_y") + F.when(F.col("swapped"), du).otherwise(dv)}).drop("pos_x", "pos_y", "min_u", "min_v", "swapped")


def coloured(pixels: DataFrame, points: DataFrame, idx: str = "idx1") -> DataFrame:
    """pixels with r, g, b of the point that each came from."""
    return pixels.join(points.select("frame_id", F.col("pt_idx").alias(idx), "r", "g", "b"), ["frame_id", idx])


def occupancy_blocks(pixels: DataFrame, block: int, least: int) -> DataFrame:
    """(frame_id, bx, by, filled, occupied): pixels of each block of the map, and whether they reach the threshold."""
    blocks = pixels.select("frame_id", "x", "y").distinct().groupBy("frame_id", F.expr(f"x div {block}").alias("bx"), F.expr(f"y div {block}").alias("by")).agg(F.count("*").alias("filled"))
    return blocks.withColumn("occupied", F.col("filled") >= least)


def kept_pixels(pixels: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Pixels whose block is occupied; those of a rejected block are zeroed, that is, gone."""
    keyed = pixels.withColumns({"bx": F.expr(f"x div {block}"), "by": F.expr(f"y div {block}")})
    return keyed.join(blocks.filter("occupied").select("frame_id", "bx", "by"), ["frame_id", "bx", "by"], "left_semi").drop("bx", "by")


def any_occupied(blocks: DataFrame, times: int) -> DataFrame:
    """Larger blocks: whether any smaller one in them is occupied, and their occupied pixels."""
    return blocks.groupBy("frame_id", F.expr(f"bx div {times}").alias("BX"), F.expr(f"by div {times}").alias("BY")).agg(F.max("occupied").alias("any"), F.sum(F.when(F.col("occupied"), F.col("filled")).otherwise(0)).alias("pixels"))


def heights(placed: DataFrame, gof_size: int, least: int, multiple: int = 8) -> DataFrame:
    """(gof_id, height): the tallest frame map of each group of frames, rounded up."""
    top = F.greatest(F.max(F.col("pos_y") + F.col("h")), F.lit(least))
    return placed.groupBy(F.expr(f"frame_id div {gof_size}").alias("gof_id")).agg(round_up(top, multiple).cast("int").alias("height"))


def _float(x: float) -> Column:
    return F.lit(x).cast("float")


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.709 luma in 32-bit floats, truncated."""
    r, g, b = (c.cast("float") for c in (r, g, b))
    return (_float(0.2126) * r + _float(0.7152) * g + _float(0.0722) * b).cast("int")


# BT.709 chroma weights of r, g, b.
CHROMA = {"cb": (-0.114572, -0.385428, 0.5), "cr": (0.5, -0.454153, -0.045847)}


def chroma(pixels: DataFrame) -> DataFrame:
    """(frame_id, cx, cy, cb, cr) from the mean colour of each full 2 x 2 block, in 32-bit floats, truncated."""
    mean = [(_float(0.25) * F.sum(c).cast("float")).alias(c) for c in "rgb"]
    blocks = pixels.groupBy("frame_id", F.expr("x div 2").alias("cx"), F.expr("y div 2").alias("cy")).agg(F.count("*").alias("n"), *mean).filter("n = 4")
    return blocks.select("frame_id", "cx", "cy", *((_float(w[0]) * F.col("r") + _float(w[1]) * F.col("g") + _float(w[2]) * F.col("b") + _float(128.0)).cast("int").alias(c) for c, w in CHROMA.items()))


def fill_from_left(blocks: DataFrame, value: str, image: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """blocks(image, by, bx, value) over a dense grid: a block without value takes that of the nearest one to its left.

    Blocks of the first column take the nearest value above them first; what has none there either stays null.
    """
    above = Window.partitionBy(*image, "bx").orderBy("by")
    left = Window.partitionBy(*image, "by").orderBy("bx")
    start = F.when(F.col("bx") == 0, F.last(value, True).over(above)).otherwise(F.col(value))
    return blocks.withColumn("_v", start).withColumn(value, F.last("_v", True).over(left)).drop("_v")


def borders(pixels: DataFrame, patch: list[str]) -> DataFrame:
    """(patch, u, v) of the pixels with an empty pixel among their four neighbours."""
    spots = pixels.select(*patch, "u", "v").distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    around = spots.withColumn("s", steps).select(*patch, (F.col("u") + F.col("s.a")).alias("nu"), (F.col("v") + F.col("s.b")).alias("nv"), "u", "v")
    empty = around.join(spots.select(*patch, F.col("u").alias("nu"), F.col("v").alias("nv")), [*patch, "nu", "nv"], "left_anti")
    return empty.select(*patch, "u", "v").distinct()
