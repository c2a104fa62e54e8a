"""Neighbourhoods on the integer grid: stencils, probes, scores, smoothing, nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PLANE_NORMALS, argmax_first

SCORES = [f"s{k}" for k in range(6)]


def stencil(most: int, with_self: bool = False) -> list[tuple[int, int, int]]:
    """Offsets with squared length up to `most`, nearest first."""
    r = math.isqrt(most)
    axis = range(-r, r + 1)
    found = [(x * x + y * y + z * z, x, y, z) for x in axis for y in axis for z in axis]
    return [(x, y, z) for d, x, y, z in sorted(found) if d <= most and (d or with_self)]


def _offsets(most: int) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((*o, sum(c * c for c in o)), ("dx", "dy", "dz", "d2")))) for o in stencil(most))))


def neighbour_pairs(points: DataFrame, most: int, idx: str = "pt_idx", xyz: tuple[str, str, str] = ("x", "y", "z"), same: tuple[str, ...] = ("ppi",), grid: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, src, dst, d2, same, carry): points of one frame within squared distance `most` and equal in columns `same`.

    carry: further columns of the neighbour.

    The stencil is a literal, so a point becomes its probes without a join; probes meet points on (frame, cell).
    """
    moved = [F.col(c) + F.col(f"o.{d}") for c, d in zip(xyz, ("dx", "dy", "dz"))]
    probes = points.select("frame_id", F.col(idx).alias("src"), *xyz, *same, _offsets(most).alias("o")).select("frame_id", "src", *(m.cast("int").alias(c) for m, c in zip(moved, xyz)), *same, F.col("o.d2").alias("d2"))
    if grid is not None:
        probes = probes.filter(" and ".join(f"{c} between 0 and {(1 << grid) - 1}" for c in xyz))
    targets = points.select("frame_id", F.col(idx).alias("dst"), *xyz, *same, *carry)
    return probes.join(targets, ["frame_id", *xyz, *same]).select("frame_id", "src", "dst", "d2", *same, *carry)


def around(points: DataFrame, most: int) -> DataFrame:
    """(frame_id, x, y, z): the cells within squared distance `most` of points, other than their own."""
    return points.select("frame_id", "x", "y", "z", _offsets(most).alias("o")).select("frame_id", *((F.col(c) + F.col(f"o.d{c}")).cast("int").alias(c) for c in "xyz"))


def extended_score(voxels: DataFrame, most: int) -> DataFrame:
    """voxels(frame_id, vox_id, vx, vy, vz, n, s0..s5) with e0..e5 and nn: sums over the neighbours; 0 without any."""
    pairs = neighbour_pairs(voxels, most, "vox_id", ("vx", "vy", "vz"), (), carry=("n", *SCORES))
    sums = pairs.groupBy("frame_id", F.col("src").alias("vox_id")).agg(F.sum("n").alias("nn"), *(F.sum(f"s{k}").alias(f"e{k}") for k in range(6)))
    found = voxels.join(sums, ["frame_id", "vox_id"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nn", *(f"e{k}" for k in range(6)))})


def is_settled() -> Column:
    """No edge around a voxel: it is no M voxel, its neighbours share one plane, and that plane is its own."""
    extended = F.array(*(f"e{k}" for k in range(6)))
    used = sum((F.col(f"e{k}") > 0).cast("int") for k in range(6))
    return (F.col("vox_class") != "M") & (used == 1) & (F.element_at(extended, F.col("ppi") + 1) > 0)


def smoothed_plane(weight: float) -> Column:
    """The plane with the largest weight / nn * extended score + normal . plane; plane 0 without neighbours."""
    normal = [F.element_at(F.array(*(F.lit(n[i]) for n in PLANE_NORMALS)), F.col("ppi") + 1) for i in range(3)]
    scores = [F.lit(weight) / F.col("nn") * F.col(f"e{k}") + sum(c * n for c, n in zip(normal, PLANE_NORMALS[k])) for k in range(6)]
    return F.when(F.col("nn") == 0, 0).otherwise(argmax_first(F.array(*scores)))


def unscaled_plane(weight: float, has_normal: Column) -> Column:
    """As smoothed_plane, without the division: weight * extended score + (normal . plane) * nn where there is a normal."""
    normal = [F.element_at(F.array(*(F.lit(n[i]) for n in PLANE_NORMALS)), F.col("ppi") + 1) for i in range(3)]
    scores = [F.lit(weight) * F.col(f"e{k}") + F.when(has_normal, sum(c * n for c, n in zip(normal, PLANE_NORMALS[k])) * F.col("nn")).otherwise(0) for k in range(6)]
    return F.when(F.col("nn") == 0, 0).otherwise(argmax_first(F.array(*scores)))


def nearest(xyz: np.ndarray, k: int, reach: int = 36, asked: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k nearest points of each, itself included; ties to the smaller index; -1 where there are fewer.

    Shells of the stencil are looked up in the sorted cells until all points have k; the few that are too isolated
    for that are compared with all. asked: the points whose neighbours are wanted (else all); the others' rows are -1.
    """
    n, k_found = len(xyz), min(k, len(xyz))
    out = np.full((n, k), -1, np.int64)
    if not n:
        return out
    wide = int(xyz.max()) + 2 * math.isqrt(reach) + 2
    key = lambda p: ((p[:, 2] + math.isqrt(reach)) * wide + p[:, 1] + math.isqrt(reach)) * wide + p[:, 0] + math.isqrt(reach)
    keys = key(xyz.astype(np.int64))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    todo, have = np.arange(n) if asked is None else asked, np.zeros(n, np.int64)
    offsets = np.array(stencil(reach, True))
    lengths = (offsets**2).sum(1)
    for d in np.unique(lengths):
        src, dst = [], []
        for o in offsets[lengths == d]:
            probe = key(xyz[todo].astype(np.int64) + o)
            low, high = np.searchsorted(ranked, probe, "left"), np.searchsorted(ranked, probe, "right")
            m = high - low
            src.append(np.repeat(todo, m))
            dst.append(order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low, m)])
        src, dst = np.concatenate(src), np.concatenate(dst)
        by = np.lexsort((dst, src))
        src, dst = src[by], dst[by]
        first = np.searchsorted(src, src, "left")
        slot = have[src] + np.arange(len(src)) - first
        use = slot < k
        out[src[use], slot[use]] = dst[use]
        have += np.bincount(src, minlength=n)
        todo = todo[have[todo] < k_found]
        if not len(todo):
            return out
    for i in todo:
        d = ((xyz.astype(np.int64) - xyz[i]) ** 2).sum(1)
        out[i, :k_found] = np.lexsort((np.arange(n), d))[:k_found]
    return out


def knn(points: DataFrame, k: int) -> DataFrame:
    """(frame_id, pt_idx, rank, nb, d2): the k nearest points of each, by (squared distance, pt_idx); rank 1 is the point itself or its twin."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx", ignore_index=True)
        xyz, idx = frame[["x", "y", "z"]].to_numpy(np.int64), frame["pt_idx"].to_numpy()
        found = nearest(xyz, k)
        src, slot = np.nonzero(found >= 0)
        dst = found[src, slot]
        return pd.DataFrame({"frame_id": np.repeat(frame["frame_id"].iloc[:1].to_numpy(), len(src)), "pt_idx": idx[src], "rank": slot + 1, "nb": idx[dst], "d2": ((xyz[src] - xyz[dst]) ** 2).sum(1)})

    return points.select("frame_id", "pt_idx", "x", "y", "z").groupBy("frame_id").applyInPandas(work, "frame_id int, pt_idx int, rank int, nb int, d2 long")
