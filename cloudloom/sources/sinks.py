"""Statistics, delays, raw images and syntax traces as files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.container import BitWriter


def write_statistics(statistics: DataFrame, folder: str) -> None:
    """A JSON line a frame; later groups of frames are appended."""
    statistics.orderBy("frame_id").write.mode("append").json(folder)


def delays(groups: DataFrame, done: str = "done", frames: str = "frames") -> DataFrame:
    """groups(gof_id, done, frames) with seconds since the group before was done, and frames a second."""
    seconds = F.col(done).cast("double") - F.lag(F.col(done).cast("double")).over(Window.orderBy("gof_id"))  # a row a group
    return groups.withColumn("delay", seconds).withColumn("fps", F.when(F.col("delay") > 0, F.col(frames) / F.col("delay")))


def raw_image(pixels: DataFrame, width: int, height: int, value: str, background: int = 0) -> DataFrame:
    """(frame_id, image): one byte a pixel in raster order, from sparse pixels (frame_id, x, y, value).

    A row's pixels are put in order once and the gaps between them are filled, so a frame costs as much as it has pixels and rows; a pixel
    given twice takes its largest value.
    """
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    blank = f"{background:02X}"
    rows = pixels.groupBy("frame_id", "y", "x").agg(F.max(value).alias("v")).groupBy("frame_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("own"))  # a row has `width` pixels at most
    begun = F.struct(F.lit(0).alias("x"), F.lit("").alias("text"))
    step = lambda acc, p: F.struct((p["x"] + 1).cast("int").alias("x"), F.concat(acc["text"], F.repeat(F.lit(blank), (p["x"] - acc["x"]).cast("int")), byte(p["v"])).alias("text"))
    line = F.aggregate("own", begun, step, lambda acc: F.concat(acc["text"], F.repeat(F.lit(blank), F.lit(width) - acc["x"])))
    lines = rows.select("frame_id", "y", line.alias("line")).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("lines"))  # `height` rows at most
    empty = blank * width
    stack = lambda acc, r: F.struct((r["y"] + 1).cast("int").alias("x"), F.concat(acc["text"], F.repeat(F.lit(empty), (r["y"] - acc["x"]).cast("int")), r["line"]).alias("text"))
    whole = F.aggregate("lines", begun, stack, lambda acc: F.concat(acc["text"], F.repeat(F.lit(empty), F.lit(height) - acc["x"])))
    return lines.select("frame_id", F.unhex(whole).alias("image"))


def repacked(planar: bytes, planes: int = 3) -> bytes:
    """Planar samples as interleaved ones."""
    size = len(planar) // planes
    out = bytearray(len(planar))
    for p in range(planes):
        out[p::planes] = planar[p * size : (p + 1) * size]
    return bytes(out)


def trace_lines(writer: BitWriter) -> list[str]:
    """`name u(n) : value` or `name ue(v) : value` for each syntax element written."""
    return [f"{name} {code} : {value}" for name, code, _, value in writer.trace if name]
