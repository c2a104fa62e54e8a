"""The patch loop: components of the points left over become patches, round by round, until none is found."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalar import PLANE_AXES
from .components import grid_edges, smallest_reached
from .neighbors import stencil

STEP, DEEPEST = 64, 255


def _near(xyz: np.ndarray, kept: np.ndarray, most: int) -> np.ndarray:
    """Which points have a kept one within squared distance `most`, other than themselves."""
    wide = int(xyz.max(initial=0)) + 32
    key = lambda p: ((p[:, 2] + 8) * wide + p[:, 1] + 8) * wide + p[:, 0] + 8
    there = np.unique(key(kept))
    if not len(there):
        return np.zeros(len(xyz), bool)
    out, own = np.zeros(len(xyz), bool), key(xyz)
    for x, y, z in stencil(most):
        probe = own + (z * wide + y) * wide + x
        at = np.minimum(np.searchsorted(there, probe), len(there) - 1)
        out |= there[at] == probe
    return out


def patches_of(frame: pd.DataFrame, least: int, propagation: int = 3, covered: int = 5, block: int = 2, distance: int = 32, thickness: int = 4, double: bool = True) -> pd.DataFrame:
    """Pixels (frame_id, patch_id, ppi, u, v, d1, idx1, d2, idx2, min_d) of all patches of one frame's points.

    The nearest point of each pixel is judged first: where it is too far from its block's peak (blocks count from the
    patch's corner) or beyond eight bits, all points of the pixel go to the next round. Points of the other pixels are
    judged by their distance behind the near layer alone. A component needs a seed without a covered point near it;
    points that failed as seeds never seed again.
    """
    frame = frame.sort_values("pt_idx", ignore_index=True)
    xyz, plane = frame[["x", "y", "z"]].to_numpy(np.int64), frame["ppi"].to_numpy(np.int64)
    left, banned = np.arange(len(frame)), np.zeros(len(frame), bool)
    kept, out, number = np.zeros((0, 3), np.int64), [], 0
    while len(left):
        may_seed = ~banned[left]
        if len(kept):
            may_seed &= ~_near(xyz[left], kept, covered)
            banned[left[~may_seed]] = True
        src, dst = grid_edges(xyz[left], plane[left], propagation)
        label = smallest_reached(len(left), src, dst)
        seeds = np.flatnonzero(may_seed)
        seeded, at = np.unique(label[seeds], return_index=True)  # components, and the first seed of each
        by = np.argsort(label, kind="stable")
        begins, ends = np.searchsorted(label[by], seeded, "left"), np.searchsorted(label[by], seeded, "right")
        again, new = [], []
        for k in np.argsort(seeds[at], kind="stable").tolist():
            own = left[by[begins[k] : ends[k]]]
            if len(own) < least:
                continue
            normal, tangent, bitangent, mode = PLANE_AXES[plane[own[0]]]
            sign = -1 if mode else 1
            u, v, d = xyz[own, tangent], xyz[own, bitangent], xyz[own, normal]
            cells = ((u - u.min()) // block) * 65536 + (v - v.min()) // block
            _, cell = np.unique(cells, return_inverse=True)
            peak = np.full(cell.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(peak, cell, sign * d)
            min_d = -(-int((-peak).max()) // STEP) * STEP if mode else int(peak.min()) // STEP * STEP
            depth = sign * (d - min_d)
            rows = pd.DataFrame({"u": u, "v": v, "depth": depth, "i": own, "off": np.abs(sign * d - peak[cell])}).sort_values(["depth", "i"])
            near = rows.drop_duplicates(["u", "v"])
            near = near[(near["off"] <= distance) & (near["depth"] <= DEEPEST - thickness)]
            rows = rows.merge(near[["u", "v", "depth", "i"]], on=["u", "v"], suffixes=("", "1"), how="left")
            again.append(rows["i"][rows["i1"].isna()].to_numpy())
            rows = rows[rows["i1"].notna()].astype({"depth1": np.int64, "i1": np.int64})
            behind = rows["depth"] - rows["depth1"]
            if double:
                far = rows[behind <= thickness].sort_values(["depth", "i"], ascending=[False, True]).drop_duplicates(["u", "v"])
                again.append(rows["i"][behind > thickness + 1].to_numpy())
            else:
                far = rows[behind == 0].drop_duplicates(["u", "v"])
                again.append(rows["i"][behind >= thickness].to_numpy())
            idx2 = np.where(far["depth"] == far["depth1"], far["i1"], far["i"])
            out.append(pd.DataFrame({"patch_id": number, "ppi": plane[own[0]], "u": far["u"], "v": far["v"], "d1": far["depth1"], "idx1": far["i1"], "d2": far["depth"], "idx2": idx2, "min_d": min_d}))
            new += [xyz[far["i1"].to_numpy()], xyz[idx2]]
            number += 1
        if not new:
            break
        kept = np.unique(np.concatenate([kept, *new]), axis=0)
        placed = np.unique(np.concatenate([p[c].to_numpy() for p in out for c in ("idx1", "idx2")]))
        left = np.setdiff1d(np.unique(np.concatenate(again)) if again else left[:0], placed)
    columns = ["frame_id", "patch_id", "ppi", "u", "v", "d1", "idx1", "d2", "idx2", "min_d"]
    if not out:
        return pd.DataFrame(columns=columns)
    found = pd.concat(out, ignore_index=True)
    idx = frame["pt_idx"].to_numpy()
    return found.assign(frame_id=frame["frame_id"].iloc[0], idx1=idx[found["idx1"]], idx2=idx[found["idx2"]])[columns]


def patch_pixels(points: DataFrame, least: int = 16, **rules: int) -> DataFrame:
    """All patches' pixels of points(frame_id, pt_idx, x, y, z, ppi); a task for each frame."""
    schema = "frame_id int, patch_id int, ppi int, u int, v int, d1 int, idx1 int, d2 int, idx2 int, min_d int"
    return points.select("frame_id", "pt_idx", "x", "y", "z", "ppi").groupBy("frame_id").applyInPandas(lambda f: patches_of(f, least, **rules), schema)
