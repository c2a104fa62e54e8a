"""Normals of points from their nearest neighbours, their orientation, and the first segmentation by plane."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalar import PLANE_NORMALS
from .neighbors import nearest


def rotation(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of quaternions (x, y, z, w), a row each."""
    v, w = q[:, :3], q[:, 3]
    out = 2 * np.einsum("ni,nj->nij", v, v)
    diagonal = w * w - (v * v).sum(1)
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        out[:, i, i] += diagonal
        out[:, j, i] += 2 * v[:, k] * w
        out[:, i, j] -= 2 * v[:, k] * w
    return out


def diagonalised(a: np.ndarray, steps: int, carried: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(diagonals, axes as columns) of symmetric 3 x 3 matrices after at most `steps` looks at them, each but the last followed by a turn.

    A look takes the largest element off the diagonal (ties: see below) and turns about its axis by the angle that
    clears it. The product with a turn is made component by component, each from those that are renewed already. With about a
    dozen steps the axes are the eigenvectors. carried: the other components of a turn stay as the last turns about those axes left
    them, as a published encoder does it; then the axes need not become the eigenvectors, however many steps they get.
    """
    n, every = len(a), np.arange(len(a))
    q, turn = np.tile([0.0, 0.0, 0.0, 1.0], (n, 1)), np.zeros((n, 4))
    axes, diagonal = np.zeros((n, 3, 3)), np.zeros((n, 3))
    live = every
    for _ in range(steps):
        if not len(live):
            break
        axes[live] = rotation(q[live])
        d = np.einsum("nji,njk,nkl->nil", axes[live], a[live], axes[live])
        diagonal[live] = np.diagonal(d, axis1=1, axis2=2)
        off = d[:, [1, 0, 0], [2, 2, 1]]
        size = np.abs(off)
        k = np.where((size[:, 0] > size[:, 1]) & (size[:, 0] > size[:, 2]), 0, np.where(size[:, 1] > size[:, 2], 1, 2))  # ties go to the later one
        row = np.arange(len(live))
        largest = off[row, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = (diagonal[live, (k + 2) % 3] - diagonal[live, (k + 1) % 3]) / (2 * largest)
            sign = np.where(theta > 0, 1.0, -1.0)
            theta = np.abs(theta)
            tangent = sign / (theta + np.where(theta < 1e6, np.sqrt(theta * theta + 1), theta))
            cosine = 1 / np.sqrt(tangent * tangent + 1)
        go = (largest != 0) & (cosine != 1)
        half = -sign * np.sqrt(np.where(go, (1 - cosine) / 2, 0))
        whole = np.sqrt(1 - half * half)
        go &= whole != 1
        live, k, half, whole = live[go], k[go], half[go], whole[go]
        if not carried:
            turn[live] = 0
        turn[live, k], turn[live, 3] = half, whole
        t, own = turn[live].T, q[live].T.copy()
        for i in range(3):
            j, m = (i + 1) % 3, (i + 2) % 3
            own[i] = own[3] * t[i] + own[i] * t[3] + own[j] * t[m] - own[m] * t[j]
        own[3] = own[3] * t[3] - (own[:3] * t[:3]).sum(0)
        q[live] = (own / np.sqrt((own * own).sum(0))).T
    return diagonal, axes


def principal_normals(xyz: np.ndarray, found: np.ndarray, steps: int | None = None, carried: bool = False) -> np.ndarray:
    """Unit vectors of the least spread of each point's neighbours (rows of `found`, itself first).

    steps, carried: the diagonaliser's; without a limit of steps the eigenvectors are exact.
    """
    near = xyz[np.where(found < 0, found[:, :1], found)].astype(float)
    centred = near - near.mean(1, keepdims=True)
    cov = np.einsum("nki,nkj->nij", centred, centred) / max(1, found.shape[1] - 1)
    if steps is None:
        values, vectors = np.linalg.eigh(cov)
        least = np.abs(values).argmin(1)
    else:
        values, vectors = diagonalised(cov, steps, carried)
        spread = np.abs(values)
        least = np.where((spread[:, 0] < spread[:, 1]) & (spread[:, 0] < spread[:, 2]), 0, np.where(spread[:, 1] < spread[:, 2], 1, 2))
    return np.take_along_axis(vectors, least[:, None, None], 2)[:, :, 0]


def orient(xyz: np.ndarray, normals: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Normals turned alike along the edges of largest agreement, from seeds that face the origin.

    A seed with neighbours that are oriented already follows their sum. Edges are taken by |n . n'|, then by the
    larger (start, end), as a max-heap of such triples would.
    """
    out, visited = normals.copy(), np.zeros(len(xyz), bool)
    edges: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        for j in found[i, 1:]:
            if j >= 0 and not visited[j]:
                heapq.heappush(edges, (-abs(float(out[i] @ out[j])), -i, -int(j)))

    for seed in range(len(xyz)):
        if visited[seed]:
            continue
        visited[seed] = True
        known = [j for j in found[seed, 1:] if j >= 0 and visited[j]]
        towards = out[known].sum(0) if known else -xyz[seed].astype(float)
        if out[seed] @ towards < 0:
            out[seed] = -out[seed]
        offer(seed)
        while edges:
            _, start, end = heapq.heappop(edges)
            start, end = -start, -end
            if not visited[end]:
                visited[end] = True
                if out[start] @ out[end] < 0:
                    out[end] = -out[end]
                offer(end)
    return out


def facing(normals: np.ndarray) -> np.ndarray:
    """The first plane with the largest dot product."""
    return (normals @ np.array(PLANE_NORMALS, float).T).argmax(1)


def with_normals(points: DataFrame, k: int = 16, k_orient: int = 4, steps: int | None = None, carried: bool = False) -> DataFrame:
    """(frame_id, pt_idx, nx, ny, nz, plane): oriented normals and the plane that each faces; a task for each frame."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx", ignore_index=True)
        xyz = frame[["x", "y", "z"]].to_numpy(np.int64)
        found = nearest(xyz, max(k, k_orient))
        n = orient(xyz, principal_normals(xyz, found[:, :k], steps, carried), found[:, :k_orient])
        return pd.DataFrame({"frame_id": frame["frame_id"], "pt_idx": frame["pt_idx"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "plane": facing(n)})

    return points.select("frame_id", "pt_idx", "x", "y", "z").groupBy("frame_id").applyInPandas(work, "frame_id int, pt_idx int, nx double, ny double, nz double, plane int")
