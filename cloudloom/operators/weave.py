"""Planes without normals: each slice is woven into chains of neighbouring points, whose steps tell the plane.

From a point of a chain the next one is looked for in an order of places around it that depends on the last step, so that a chain keeps
to the outside of what it goes around; points that are about as near become children of the point they were seen from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SLICE_PLANES
from .slices import levels

REACH = 3
# The orders in which places are looked at after a step upwards or up to the left. Rows go from a + 3 down to a - 3, columns from
# b - 3 to b + 3; a dot is a place that is not looked at. The orders after other steps are these, turned.
ORDERS = """
 .  . 19 13 14  .  .    .  . 14  8  9  .  .    .  . 15  9 10  .  .
 . 20 12  7  8 11  .    . 15  7  4  5  6  .    . 16  8  4  6  7  .
23 18  6  5  2  4 10   18 13  3  2  1  .  .   19 14  3  2  1  5  .
22 17 15  .  1  3  9   17 12 10  .  .  .  .   18 13 11  .  .  .  .
26 21 16  .  .  .  .   22 16 11 19  .  .  .   23 17 12 20  .  .  .
 . 27 25 24  .  .  .    . 23 21 20 24 28  .    . 24 22 21  .  .  .
 .  . 29 28  .  .  .    .  . 26 25 27  .  .    .  . 27 26 28  .  .

 .  . 16 10 11  .  .    .  . 13  7  8  .  .    .  .  8  6  7  .  .
 . 17  9  4  6  8  .    . 14  6  4  5  .  .    . 12  5  4  .  .  .
20 15  3  2  1  5  7   17 12  2  1  .  .  .   15  9  2  1  .  .  .
19 14 12  .  .  .  .   16 11  3  .  .  .  .   14 11  3  .  .  .  .
24 18 13 21  .  .  .   21 15  9 10 18  .  .   20 13 10 16 17 25  .
 . 25 23 22  .  .  .    . 22 20 19 23 27  .    . 21 19 18 22 26  .
 .  . 27 26  .  .  .    .  . 25 24 26  .  .    .  . 24 23 27  .  .
"""
# Which of the six is for a step up (any number of rows) or to the upper left.
BASE = {(1, 0): 0, (2, 0): 0, (3, 0): 0, (1, -1): 1, (2, -2): 1, (2, -1): 2, (3, -1): 3, (1, -2): 4, (1, -3): 5}
# Rings of places by |a| (rows) and |b| (columns), 0 to 3.
RINGS = ((0, 1, 2, 5), (1, 1, 3, 6), (2, 3, 4, 7), (5, 6, 7, 8))


def ring(step: tuple[int, int]) -> int:
    return RINGS[abs(step[0])][abs(step[1])]


def _tables() -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """{step: {place: rank}} for every step, places in the order of their ranks: the six orders in each of four turns."""
    blocks = [[line.split() for line in b.splitlines()] for b in ORDERS.strip("\n").split("\n\n")]
    matrices = [np.array([[0 if c == "." else int(c) for c in line[7 * i : 7 * i + 7]] for line in block]) for block in blocks for i in range(3)]
    out = {}
    for step, base in BASE.items():
        matrix = matrices[base]
        for _ in range(4):
            ranks = {(REACH - i, j - REACH): int(matrix[i, j]) for i, j in np.argwhere(matrix)}
            out[step] = dict(sorted(ranks.items(), key=lambda x: x[1]))
            step, matrix = (step[1], -step[0]), np.rot90(matrix)
    return out


_RANKS = _tables()
#: What is looked at after a step: an order ends before the first rank that no place has.
_LISTS = {step: [(ring(place), *place) for n, (place, rank) in enumerate(ranks.items(), 1) if n == rank] for step, ranks in _RANKS.items()}


def closes(home: tuple[int, int], step: tuple[int, int], move: tuple[int, int]) -> bool:
    """Whether a chain ends here: its start (at home from here) is nearer than the next point (at move), or as near and looked at no later.

    The start's nearness is its squared distance (1 for a diagonal neighbour), the next point's its ring. A start that lies just where
    the last step came from ends nothing when both are as near.
    """
    near = 1 if abs(home[0]) == abs(home[1]) == 1 else home[0] ** 2 + home[1] ** 2
    if near != ring(move):
        return near < ring(move)
    if home == (-step[0], -step[1]):
        return False
    return _RANKS[step].get(home, 0) <= _RANKS[step][move]


def weave(a: np.ndarray, b: np.ndarray, axis: int) -> tuple[list[int | None], list[int | None]]:
    """(plane, parent) of each point of a slice, given in slice order; a point has one of both.

    A point at the place of another takes that one as its parent.
    """
    planes, parents = [None] * len(a), [None] * len(a)
    spot = list(zip(a.tolist(), b.tolist()))
    free = {at: i for i, at in reversed(list(enumerate(spot)))}
    first = dict(free)
    taken = [False] * len(a)

    def facing(step: tuple[int, int]) -> int:
        dots = (step[1], -step[0], -step[1], step[0])
        return SLICE_PLANES[axis][dots.index(max(dots))]

    for start in range(len(a)):
        if taken[start]:
            continue
        taken[start] = True
        if first[spot[start]] != start:
            parents[start] = first[spot[start]]
            continue
        free.pop(spot[start], None)
        chain, steps, seen = [start], [], []
        here, step, home = start, (1, 0), None
        while True:
            found = None
            x, y = spot[here]
            for d, da, db in _LISTS[step]:
                at = (x + da, y + db)
                other = free.get(at)
                if other is None:
                    continue
                if found is None:
                    found, near, move = other, d, (da, db)
                    del free[at]
                elif d <= near + 1 and not taken[other]:
                    taken[other], parents[other] = True, here
                    seen.append(at)
            if found is None:
                break
            if home is not None and closes(home, step, move):
                if not taken[found]:
                    taken[found], parents[found] = True, here
                break
            steps.append(facing(move) if home is None or abs(move[0]) != abs(move[1]) else None)
            taken[found], parents[found] = True, None
            chain.append(found)
            here, step = found, move
            home = (spot[start][0] - spot[here][0], spot[start][1] - spot[here][1])
        for at in seen:
            free.pop(at, None)
        if home is None:
            steps = [0]
        else:
            steps.append(steps[-1] if steps[-1] is not None else facing(home))
        known = [i for i, s in enumerate(steps) if s is not None]
        for low, high in zip(known, known[1:]):
            half = (high - low - 1) // 2 + 1
            for i in range(low + 1, high):
                steps[i] = steps[low] if steps[low] == steps[high] or i - low <= half else steps[high]
        for i, s in zip(chain, steps):
            planes[i] = s
    return planes, parents


def woven(points: DataFrame) -> DataFrame:
    """(frame_id, axis, pt_idx, plane, parent) from the slices across all three axes; a task for each slice."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        planes, parents = weave(group["a"].to_numpy(), group["b"].to_numpy(), int(group["axis"].iloc[0]))
        idx = group["pt_idx"].to_numpy()
        return pd.DataFrame({"frame_id": group["frame_id"], "axis": group["axis"], "pt_idx": idx, "plane": pd.array(planes, "Int32"), "parent": pd.array([None if p is None else idx[p] for p in parents], "Int32")})

    return levels(points).groupBy("frame_id", "axis", "level").applyInPandas(work, "frame_id int, axis int, pt_idx int, plane int, parent int")


def sliced_votes(points: DataFrame) -> DataFrame:
    """(frame_id, pt_idx, plane_x.., parent_x.., ppi): what the slices across each axis say of a point; ppi is null where they decide nothing."""
    from .slices import voted

    rows = woven(points).groupBy("frame_id", "pt_idx").agg(*(F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}_{n}") for c in ("plane", "parent") for i, n in enumerate("xyz")))
    return rows.withColumn("ppi", voted(F.col("plane_x"), F.col("plane_y"), F.col("plane_z")))


def sliced_planes(points: DataFrame) -> DataFrame:
    """(frame_id, pt_idx, plane): the votes of the three axes; undecided points follow their parents."""
    return settled(sliced_votes(points))


def settled(votes: DataFrame) -> DataFrame:
    """(frame_id, pt_idx, plane): points without a plane take that of their parents in y, x, z, else the votes in that order."""
    from .slices import inherited

    done = inherited(votes).withColumn("plane", F.coalesce("ppi", "plane_y", "plane_x", "plane_z", F.lit(0)))
    return done.select("frame_id", "pt_idx", "plane")
