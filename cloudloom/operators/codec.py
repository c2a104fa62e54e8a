"""Coding of map images: a protocol for video codecs, a raw one, and map images from map pixels."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import color, fill
from .container import unit

#: Map -> unit type, in coded order.
MAPS = {"occupancy": "OVD", "geometry": "GVD", "attribute": "AVD"}


class MapCodec(Protocol):
    """Codes one group's images of one map, in frame order (near and far layer of a frame in turns).

    Its group is the profile's codec group in the parameter sets (1 where it has none), codecs the codec id of each map (the group where it names none).
    A codec with a method configured(options) is asked for one that is set up: options[map] is Parameters.codec_options of the map.
    """

    def encode(self, kind: str, images: list[np.ndarray]) -> bytes: ...


class RawCodec:
    """Planar bytes, one image after the other: what a video codec would be given."""

    def encode(self, kind: str, images: list[np.ndarray]) -> bytes:
        return b"".join(np.ascontiguousarray(i).tobytes() for i in images)


def occupied(frame: pd.DataFrame, width: int, height: int, block: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pixels, which blocks) are occupied: a block with fewer pixels than the threshold loses them all."""
    pixels = np.zeros((height, width), bool)
    pixels[frame["y"].to_numpy(), frame["x"].to_numpy()] = True
    blocks = pixels.reshape(height // block, block, width // block, block).sum((1, 3)) >= threshold
    return pixels & np.repeat(np.repeat(blocks, block, 0), block, 1), blocks


def _attribute(colour: np.ndarray, pixels: np.ndarray, blocks: np.ndarray, block: int, background: int, fill_: str, fill_block: int) -> np.ndarray:
    """One channel with its background filled."""
    if fill_ == "patchExtension":
        return fill.copy_left(fill.dilate_blocks(colour, blocks, block, background), blocks, block)
    if fill_ == "bbpe":
        return fill.grow_blocks(colour, pixels, fill_block)
    return fill.pull_push(colour, pixels) if fill_ == "pushPull" else colour


def images(frame: pd.DataFrame, width: int, height: int, block: int, layers: int = 2, threshold: int = 1, geometry: int = 128, attribute: int = 128, fill_: str = "patchExtension", fill_block: int = 8, filtered_chroma: bool = False) -> dict[str, list[np.ndarray]]:
    """One frame's images from its pixels (x, y, d1, d2, r, g, b): occupancy by block, geometry filled, attributes filled and in YUV 4:2:0.

    A frame without pixels is one row of nulls: all background. An attribute image is its luma rows, then its two chroma planes, as rows of the same width.
    """
    frame = frame.dropna(subset="x").astype({c: int for c in frame.columns})
    at = frame["y"].to_numpy(), frame["x"].to_numpy()
    pixels, blocks = occupied(frame, width, height, block, threshold)
    out: dict[str, list[np.ndarray]] = {"occupancy": [blocks.astype(np.uint8)], "geometry": [], "attribute": []}
    for d in ("d1", "d2")[:layers]:
        depth = np.full((height, width), geometry, np.uint8)
        depth[at] = frame[d]
        out["geometry"].append(fill.copy_left(fill.dilate_blocks(depth, blocks, block, geometry), blocks, block))
        rgb = np.full((3, height, width), attribute, np.uint8)
        for c, name in enumerate("rgb"):
            rgb[c][at] = frame[name]
            rgb[c] = _attribute(rgb[c], pixels, blocks, block, attribute, fill_, fill_block)
        y, u, v = (color.filtered_yuv if filtered_chroma else color.yuv)(rgb.transpose(1, 2, 0))
        out["attribute"].append(np.concatenate([y, u.reshape(-1, width), v.reshape(-1, width)]))
    return out


def _tall(group: pd.DataFrame, height: int, block: int) -> int:
    return height if group["y"].isna().all() else max(height, -(-(int(group["y"].max()) + 1) // (8 * block)) * 8 * block)


def finished(pixels: DataFrame, gof_size: int, width: int, height: int, block: int, **rules: object) -> DataFrame:
    """(frame_id, map, layer, y, line): the rows of all finished images of map pixels; a task for each group of frames."""

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tall, rows = _tall(group, height, block), []
        for frame_id, own in group.groupby("frame_id"):
            for name, found in images(own, width, tall, block, **rules).items():
                rows += [(frame_id, name, layer, y, line.tobytes()) for layer, image in enumerate(found) for y, line in enumerate(image)]
        return pd.DataFrame(rows, columns=["frame_id", "map", "layer", "y", "line"])

    keyed = pixels.selectExpr("*", f"frame_id div {gof_size} as gof_id")
    return keyed.groupBy("gof_id").applyInPandas(work, "frame_id int, map string, layer int, y int, line binary")


def video_units(pixels: DataFrame, gof_size: int, width: int, height: int, block: int, codec: MapCodec | None = None, **rules: object) -> DataFrame:
    """(gof_id, unit_seq, unit_type, payload): occupancy, geometry and attribute units of map pixels; a task for each group."""
    codec = codec or RawCodec()

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gof, tall = int(key[0]), _tall(group, height, block)
        frames = [images(own, width, tall, block, **rules) for _, own in sorted(group.groupby("frame_id"))]
        rows = [(gof, i + 2, kind, unit(kind, gof, codec.encode(name, [x for f in frames for x in f[name]]))) for i, (name, kind) in enumerate(MAPS.items())]
        return pd.DataFrame(rows, columns=["gof_id", "unit_seq", "unit_type", "payload"])

    keyed = pixels.selectExpr("*", f"frame_id div {gof_size} as gof_id")
    return keyed.groupBy("gof_id").applyInPandas(work, "gof_id long, unit_seq int, unit_type string, payload binary")


def low_delay_units(pixels: DataFrame, gof_size: int, width: int, height: int, block: int, codec: MapCodec | None = None, **rules: object) -> DataFrame:
    """As video_units, with a group of units for each frame: unit_seq goes on over the frames of a group, after the atlas of each."""
    codec = codec or RawCodec()

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gof, tall, rows = int(key[0]), _tall(group, height, block), []
        for frame_id, own in sorted(group.groupby("frame_id")):
            place = int(frame_id) - gof * gof_size
            found = images(own, width, tall, block, **rules)
            rows += [(gof, 1 + 4 * place + 1 + i, kind, unit(kind, gof, codec.encode(name, found[name]))) for i, (name, kind) in enumerate(MAPS.items())]
        return pd.DataFrame(rows, columns=["gof_id", "unit_seq", "unit_type", "payload"])

    keyed = pixels.selectExpr("*", f"frame_id div {gof_size} as gof_id")
    return keyed.groupBy("gof_id").applyInPandas(work, "gof_id long, unit_seq int, unit_type string, payload binary")
