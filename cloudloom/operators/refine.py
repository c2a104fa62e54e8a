"""Iterative refinement of the planes of points by the voxels around them, in voxel order within a frame.

Voxels change class while a sweep goes on and later voxels of the sweep see it; scores are renewed only after it. So a
frame is refined in one task, voxel after voxel; frames are refined side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PLANE_NORMALS
from .neighbors import stencil

NO_EDGE, INDIRECT, SINGLE, MULTI = range(4)
CLASSES = ("no_edge", "indirect_edge", "single_edge", "multi_edge")
#: Of a sweep: voxels that it passes over, voxels of each class after it, points whose scores it computes, voxels of each class whose points it
#: judges, points that change their plane.
COUNTERS = ("skipped_voxels", *CLASSES, "score_computations", *(f"{c}_refined" for c in CLASSES), "plane_changes")


def neighbourhoods(cells: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, neighbour, squared distance) of all pairs of distinct cells within a squared distance, by cell."""
    wide, low = int(np.ptp(cells, axis=0).max(initial=0)) + 2 * reach + 3, cells.min(0) - reach - 1
    key = lambda c: ((c[:, 0] - low[0]) * wide + c[:, 1] - low[1]) * wide + c[:, 2] - low[2]
    keys = key(cells.astype(np.int64))
    order = np.argsort(keys)
    ranked, pairs = keys[order], []
    for x, y, z in stencil(reach):
        probe = keys + (x * wide + y) * wide + z
        at = np.minimum(np.searchsorted(ranked, probe), len(ranked) - 1)
        src = np.flatnonzero(ranked[at] == probe)
        pairs.append((src, order[at[src]], np.full(len(src), x * x + y * y + z * z)))
    src, dst, d2 = (np.concatenate(c) for c in zip(*pairs))
    by = np.argsort(src, kind="stable")
    return src[by], dst[by], d2[by]


def refine(xyz: np.ndarray, plane: np.ndarray, normals: np.ndarray | None, shift: int, reach: int = 2, indirect: int = 4, weight: float = 3.5, sweeps: int = 3, log: list[dict[str, int]] | None = None) -> np.ndarray:
    """Refined planes. log gets the COUNTERS of every sweep.

    reach and indirect: squared distances of the voxels that count, and of those whose class a voxel may change.
    With normals, a plane's score is weight / neighbours * votes + normal . plane; without them (the sliced variant)
    weight * votes + neighbours * (the plane at the start) . plane. Within a sweep only classes change, so votes and new
    planes are found for all voxels at once; what goes voxel by voxel is who wakes whom.
    """
    plane = plane.copy()
    if not len(plane):
        return plane
    voxels, first, owner = np.unique(xyz >> shift, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")  # voxels in the order of their first points
    rank = np.argsort(order)
    voxels, owner = voxels[order], rank[owner.reshape(-1)]
    n = len(voxels)
    src, dst, d2 = neighbourhoods(voxels, reach)
    close = d2 <= indirect
    wakes, starts = dst[close].tolist(), np.searchsorted(src[close], np.arange(n + 1)).tolist()
    size = np.bincount(owner, minlength=n)
    around = np.bincount(src, size[dst], n)
    axes = (normals if normals is not None else np.array(PLANE_NORMALS, float)[plane]) @ np.array(PLANE_NORMALS, float).T

    def scores() -> np.ndarray:
        return np.bincount(owner * 6 + plane, minlength=6 * n).reshape(n, 6)

    score = scores()
    own = score.argmax(1)
    kind = np.where(size == 1, SINGLE, np.where((score > 0).sum(1) == 1, NO_EDGE, MULTI))
    for _ in range(sweeps):
        votes = np.stack([np.bincount(src, score[dst, k], n) for k in range(6)], 1)
        top = votes.argmax(1).tolist()
        classes, owns = kind.tolist(), own.tolist()
        visited = np.zeros(n, bool)
        for i in range(n):
            if classes[i] == NO_EDGE:
                continue
            visited[i] = True
            for j in wakes[starts[i] : starts[i + 1]]:
                if classes[j] == NO_EDGE and owns[j] != top[i]:
                    classes[j] = INDIRECT
        kind = np.array(classes)
        settled = (kind != MULTI) & ((votes > 0).sum(1) == 1) & (votes[np.arange(n), own] > 0)
        touched = visited & ~settled
        mine = touched[owner]
        with np.errstate(divide="ignore", invalid="ignore"):
            if normals is not None:
                best = ((weight / around[:, None] * votes)[owner[mine]] + axes[mine]).argmax(1)
            else:
                best = ((weight * votes)[owner[mine]] + around[owner[mine], None] * axes[mine]).argmax(1)
        before, judged = plane[mine], np.bincount(kind[touched], minlength=4)
        plane[mine] = np.where(around[owner[mine]] == 0, 0, best)
        score = np.where(touched[:, None], scores(), score)
        own = np.where(touched, score.argmax(1), own)
        kind = np.where(touched, np.where(size == 1, SINGLE, np.where((score > 0).sum(1) == 1, NO_EDGE, MULTI)), kind)
        if log is not None:
            log.append(dict(zip(COUNTERS, map(int, (n - visited.sum(), *np.bincount(kind, minlength=4), mine.sum(), *judged, (plane[mine] != before).sum())))))
    return plane


def refined(points: DataFrame, shift: int = 1, reach: int = 2, indirect: int = 4, weight: float = 3.5, sweeps: int = 3, use_normals: bool = True) -> DataFrame:
    """(frame_id, pt_idx, plane) of points(frame_id, pt_idx, x, y, z, plane and, with use_normals, nx, ny, nz)."""
    return planes_of(refined_with_counters(points, shift, reach, indirect, weight, sweeps, use_normals))


def planes_of(rows: DataFrame) -> DataFrame:
    """(frame_id, pt_idx, plane) of what refined_with_counters gives."""
    return rows.filter("sweep is null").select("frame_id", "pt_idx", "plane")


def counters_of(rows: DataFrame) -> DataFrame:
    """(frame_id, sweep, COUNTERS) of what refined_with_counters gives."""
    return rows.filter("sweep is not null").select("frame_id", "sweep", *(F.col("counters")[i].alias(c) for i, c in enumerate(COUNTERS)))


def refined_with_counters(points: DataFrame, shift: int = 1, reach: int = 2, indirect: int = 4, weight: float = 3.5, sweeps: int = 3, use_normals: bool = True) -> DataFrame:
    """Two kinds of rows from one pass: (frame_id, pt_idx, plane) of every point, and (frame_id, sweep, counters) of every sweep."""
    extra = ["nx", "ny", "nz"] if use_normals else []

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx", ignore_index=True)
        normals = frame[extra].to_numpy(float) if extra else None
        log: list[dict[str, int]] = []
        plane = refine(frame[["x", "y", "z"]].to_numpy(np.int64), frame["plane"].to_numpy(np.int64), normals, shift, reach, indirect, weight, sweeps, log)
        n, more = len(frame), len(log)
        whole = lambda values: pd.array(values, "Int32")
        return pd.DataFrame({
            "frame_id": frame["frame_id"].iloc[0],
            "pt_idx": whole([*frame["pt_idx"], *[None] * more]),
            "plane": whole([*plane, *[None] * more]),
            "sweep": whole([*[None] * n, *range(more)]),
            "counters": [*[None] * n, *([c[k] for k in COUNTERS] for c in log)],
        })

    return points.select("frame_id", "pt_idx", "x", "y", "z", "plane", *extra).groupBy("frame_id").applyInPandas(work, "frame_id int, pt_idx int, plane int, sweep int, counters array<long>")
