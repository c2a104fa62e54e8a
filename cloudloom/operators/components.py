"""Connected components of points that share a plane and lie within a squared distance of each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import stencil


def grid_edges(xyz: np.ndarray, plane: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points on one plane within squared distance `most`, each pair once."""
    wide = int(xyz.max(initial=0)) + 64
    keys = ((plane.astype(np.int64) * wide + xyz[:, 2] + 16) * wide + xyz[:, 1] + 16) * wide + xyz[:, 0] + 16
    order = np.argsort(keys, kind="stable")
    ranked, src, dst = keys[order], [], []
    half = [o for o in stencil(most) if (o[2], o[1], o[0]) > (0, 0, 0)]
    for x, y, z in half:
        probe = keys + (z * wide + y) * wide + x
        at = np.minimum(np.searchsorted(ranked, probe), len(ranked) - 1)
        hit = ranked[at] == probe
        src.append(np.flatnonzero(hit))
        dst.append(order[at[hit]])
    return np.concatenate(src), np.concatenate(dst)


def smallest_reached(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over undirected edges: hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        open_ = a != b
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(points: DataFrame, most: int = 3) -> DataFrame:
    """points(frame_id, pt_idx, x, y, z, ppi) with `component`, the smallest pt_idx of the component; a task for each frame and plane."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pt_idx", ignore_index=True)
        src, dst = grid_edges(group[["x", "y", "z"]].to_numpy(np.int64), group["ppi"].to_numpy(), most)
        label = smallest_reached(len(group), src, dst)
        return group.assign(component=group["pt_idx"].to_numpy()[label])

    rows = points.select("frame_id", "pt_idx", "x", "y", "z", "ppi")
    return rows.groupBy("frame_id", "ppi").applyInPandas(work, "frame_id int, pt_idx int, x int, y int, z int, ppi int, component int")


def large_enough(found: DataFrame, least: int) -> DataFrame:
    """(frame_id, component, ppi, points) of the components with at least `least` points."""
    return found.groupBy("frame_id", "component").agg(F.first("ppi").alias("ppi"), F.count("*").alias("points")).filter(F.col("points") >= least)
