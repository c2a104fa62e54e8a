"""Placing patches on the atlas: first fit within a frame, and shared places for patches that go on through a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Atlas:
    """An occupancy map that grows in height; patches are rectangles in blocks of `block` pixels."""

    def __init__(self, width: int, height: int, block: int, space: int, grows: bool = True):
        self.block, self.space, self.grows = block, space, grows
        self.used = np.zeros((height // block, width // block), bool)

    def fits(self, x: int, y: int, w: int, h: int) -> bool:
        """Whether the rectangle and its margin lie on free blocks; the margin ends at the map's edges."""
        rows, cols = self.used.shape
        if x + w > cols or y + h > rows:
            return False
        return not self.used[max(0, y - self.space) : y + h + self.space, max(0, x - self.space) : x + w + self.space].any()

    def place(self, w: int, h: int) -> tuple[int, int, bool] | None:
        """First fit in raster order with steps of 1 + space blocks, as it stands before turned; (x, y, turned)."""
        while True:
            before = np.zeros(np.add(self.used.shape, 1), np.int32)  # used blocks above and to the left
            np.cumsum(np.cumsum(self.used, 0), 1, out=before[1:, 1:])
            straight, turned = self._spots(before, w, h), self._spots(before, h, w)
            either = straight | turned
            if either.any():
                y, x = divmod(int(either.argmax()), either.shape[1])
                return x * (1 + self.space), y * (1 + self.space), not straight[y, x]
            if not self.grows or min(w, h) > self.used.shape[1]:
                return None
            self.used = np.vstack([self.used, np.zeros_like(self.used)])

    def _spots(self, before: np.ndarray, w: int, h: int) -> np.ndarray:
        """Whether the rectangle fits, for each place of the raster; before: prefix sums of the used blocks."""
        rows, cols = self.used.shape
        y, x = np.arange(0, rows, 1 + self.space), np.arange(0, cols, 1 + self.space)
        top, left = np.maximum(0, y - self.space)[:, None], np.maximum(0, x - self.space)[None]
        bottom, right = np.minimum(rows, y + h + self.space)[:, None], np.minimum(cols, x + w + self.space)[None]
        used = before[bottom, right] - before[top, right] - before[bottom, left] + before[top, left]
        return (used == 0) & (y + h <= rows)[:, None] & (x + w <= cols)[None]

    def cover(self, x: int, y: int, w: int, h: int, turned: bool, filled: np.ndarray | None = None) -> None:
        own = np.ones((h, w), bool) if filled is None else filled
        own = own.T if turned else own
        self.used[y : y + own.shape[0], x : x + own.shape[1]] |= own


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(longer=frame[["w", "h"]].max(axis=1)).sort_values(["longer", "patch_id"], ascending=[False, True])


def pack_frame(frame: pd.DataFrame, atlas: Atlas) -> list[tuple[int, int, int, int, bool, bool]]:
    """(frame_id, patch_id, x, y, turned, discarded) of patches(w, h in blocks), largest first."""
    out = []
    for r in _in_order(frame).itertuples():
        spot = atlas.place(r.w, r.h)
        if spot is not None:
            atlas.cover(spot[0], spot[1], r.w, r.h, spot[2])
        out.append((r.frame_id, r.patch_id, *(spot or (0, 0, False)), spot is None))
    return out


def overlap(a: pd.Series, b: pd.Series) -> np.float32:
    w = max(0, min(a.u + a.w, b.u + b.w) - max(a.u, b.u))
    h = max(0, min(a.v + a.h, b.v + b.h) - max(a.v, b.v))
    return np.float32(w * h) / np.float32(a.w * a.h + b.w * b.h - w * h)


def match(now: pd.DataFrame, before: pd.DataFrame, threshold: float) -> dict[int, int]:
    """Row of now -> row of before: greedy, in the order of the earlier frame's matched patches."""
    free, out = list(now.index), {}
    for i in before.index[before["chained"]]:
        best, most = None, np.float32(threshold)
        for j in free:
            if now.at[j, "ppi"] % 3 == before.at[i, "ppi"] % 3 and (o := overlap(now.loc[j], before.loc[i])) > most:
                best, most = j, o
        if best is not None:
            free.remove(best)
            out[best] = i
    return out


def pack_group(group: pd.DataFrame, width: int, height: int, block: int, space: int, threshold: float, grows: bool = True) -> list[tuple[int, int, int, int, bool, bool]]:
    """As pack_frame, for a group of frames: patches that go on through all of them share one place.

    A frame without patches ends every chain. A chain whose shared rectangle has no place is packed frame by frame.
    """
    frames = [_in_order(f).reset_index(drop=True) for _, f in sorted(group.groupby("frame_id"))]
    ids = group["frame_id"]
    if len(frames) == 1 or ids.max() - ids.min() + 1 > len(frames):
        return [row for f in frames for row in pack_frame(f, Atlas(width, height, block, space, grows))]
    frames[0]["chained"] = True
    links: list[dict[int, int]] = []
    for before, now in zip(frames, frames[1:]):
        links.append(match(now, before, threshold))
        now["chained"] = now.index.isin(links[-1])
    unions = []
    for last in frames[-1].index[frames[-1]["chained"]]:
        chain = [last]
        for link in reversed(links):
            chain.append(link[chain[-1]])
        rows = [f.loc[i] for f, i in zip(reversed(frames), chain)]
        unions.append((max(r.w for r in rows), max(r.h for r in rows), [(int(r.frame_id), int(r.patch_id)) for r in rows]))
    atlas, shared, out = Atlas(width, height, block, space, grows), {}, []
    for w, h, chain in sorted(unions, key=lambda u: -max(u[0], u[1])):
        if (spot := atlas.place(w, h)) is not None:
            atlas.cover(spot[0], spot[1], w, h, spot[2])
            shared |= {p: spot for p in chain}
    for f in frames:
        own = Atlas(width, atlas.used.shape[0] * block, block, space, grows)
        rest = []
        for r in f.itertuples():
            if spot := shared.get((r.frame_id, r.patch_id)):
                own.cover(spot[0], spot[1], r.w, r.h, spot[2])
                out.append((r.frame_id, r.patch_id, *spot, False))
            else:
                rest.append(r.Index)
        out += pack_frame(f.loc[rest], own)
    return out


SCHEMA = "frame_id int, patch_id int, pos_x int, pos_y int, swapped boolean, discarded boolean"


def _frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["frame_id", "patch_id", "pos_x", "pos_y", "swapped", "discarded"])


def pack_intra(patches: DataFrame, width: int = 64, height: int = 64, block: int = 4, space: int = 1, grows: bool = True) -> DataFrame:
    """Places (in blocks) of patches(frame_id, patch_id, w, h in blocks); a task for each frame."""
    return patches.groupBy("frame_id").applyInPandas(lambda f: _frame_of(pack_frame(f, Atlas(width, height, block, space, grows))), SCHEMA)


def pack_inter(patches: DataFrame, gof_size: int, width: int = 64, height: int = 64, block: int = 4, space: int = 1, threshold: float = 0.3, grows: bool = True) -> DataFrame:
    """Places of patches(frame_id, patch_id, ppi, u, v, w, h); a task for each group of frames."""
    keyed = patches.selectExpr("*", f"frame_id div {gof_size} as gof_id")
    return keyed.groupBy("gof_id").applyInPandas(lambda g: _frame_of(pack_group(g, width, height, block, space, threshold, grows)), SCHEMA)
