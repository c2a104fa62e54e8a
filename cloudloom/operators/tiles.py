"""Neighbours and oriented normals of frames of any size, by cubic tiles: no task needs a whole frame.

Nearest neighbours: a tile's task gets the tile's points and those within `halo` cells of it. A point is done when its kth neighbour is no
further than the halo reaches, or the tile saw the whole frame; the others go on with a halo twice as wide. Every point's own neighbours are thus exact,
ties by pt_idx.

Orientation: the edges of the neighbour graph with the largest agreement |n . n'| first are a maximum spanning forest, found in rounds
(Boruvka): every component takes its best edge out, joined components get one name and their normals one sign. A component that is whole
faces the origin at its point with the smallest pt_idx. Edges within a component are dropped each round, and tasks
contract what edges they hold, so rounds are few and each is a shuffle of what is left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .neighbors import nearest
from .normals import facing, principal_normals

#: Side of a tile and first halo, in cells.
TILE, HALO = 64, 4
NEAR = "frame_id int, pt_idx int, tx int, ty int, tz int, x int, y int, z int, nb array<int>, nx double, ny double, nz double, done boolean"


def _tiled(points: DataFrame, tile: int, halo: int) -> DataFrame:
    """points with own, for each tile (tx, ty, tz) that needs them: its own points and those within the halo of it."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    rows = points
    for c in "xyz":
        rows = rows.withColumn(f"t{c}", F.explode(span(c)))
    own = reduce(lambda a, b: a & b, (F.col(f"t{c}") == F.floor(F.col(c) / tile) for c in "xyz"))
    return rows.withColumn("own", own)


def _neighbours(points: DataFrame, asked: DataFrame, k: int, k_orient: int, tile: int, halo: int, steps: int | None, carried: bool) -> DataFrame:
    """NEAR rows of the asked points (a tile each), by what lies within the halo of their tiles."""
    keys = ["frame_id", "tx", "ty", "tz"]
    tiles = asked.select(*keys).distinct()
    around = _tiled(points, tile, halo).join(tiles, keys, "left_semi")
    wanted = asked.select(*keys, "pt_idx").withColumn("wanted", F.lit(True))
    total = points.groupBy("frame_id").agg(F.count("*").alias("total"))  # a row a frame
    rows = around.join(wanted, [*keys, "pt_idx"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)) & F.col("own")).join(F.broadcast(total), "frame_id")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pt_idx", ignore_index=True)
        xyz, idx, total = group[["x", "y", "z"]].to_numpy(np.int64), group["pt_idx"].to_numpy(), int(group["total"].iloc[0])
        low = xyz.min(0)
        ask = np.flatnonzero(group["wanted"].to_numpy())
        found = nearest(xyz - low, max(k, k_orient), asked=ask)[ask]
        last = np.where((found >= 0).all(1), found[:, -1], -1)
        far = ((xyz[ask] - xyz[last]) ** 2).sum(1)
        done = (last >= 0) & (far <= halo * halo) | (len(group) == total)
        n = principal_normals(xyz, found[:, :k], steps, carried)
        names = np.where(found >= 0, idx[found], -1)[:, :k_orient]
        out = group.loc[ask, ["frame_id", "pt_idx", "tx", "ty", "tz", "x", "y", "z"]].reset_index(drop=True)
        return out.assign(nb=[[int(i) for i in row if i >= 0] for row in names], nx=n[:, 0], ny=n[:, 1], nz=n[:, 2], done=done)

    return rows.groupBy(*keys).applyInPandas(work, NEAR)


def unoriented(points: DataFrame, k: int = 16, k_orient: int = 4, steps: int | None = None, carried: bool = False, tile: int | None = None, halo: int | None = None) -> DataFrame:
    """(frame_id, pt_idx, x, y, z, nb, nx, ny, nz): normals of either sign and the k_orient nearest points (itself first), as a table in the shared folder."""
    tile, halo = tile or TILE, halo or HALO
    folder = scratch.shared(points.sparkSession, "tiles")
    points = scratch.written(points.select("frame_id", "pt_idx", "x", "y", "z"), f"{folder}/points")
    asked, parts = points, []
    while True:
        side = max(tile, 2 * halo)  # so a point is sent to eight tiles at most, however wide the halo
        at = [F.floor(F.col(c) / side).cast("int").alias(f"t{c}") for c in "xyz"]
        part = scratch.written(_neighbours(points, asked.select("frame_id", "pt_idx", *at), k, k_orient, side, halo, steps, carried), f"{folder}/halo{halo}")
        parts.append(part.filter("done"))
        asked, halo = part.filter("not done").select("frame_id", "pt_idx", "x", "y", "z"), 2 * halo
        if asked.isEmpty():
            return reduce(DataFrame.unionByName, parts).drop("tx", "ty", "tz", "done")


SIGNED = "frame_id int, u int, v int, sign int, w double, a int, b int"


def _best(edges: DataFrame) -> DataFrame:
    """Of each component (frame_id, c) the edge that comes first: the largest agreement, then the smallest (a, b); as to, sign."""
    both = edges.select("frame_id", F.col("u").alias("c"), F.col("v").alias("to"), "sign", "w", "a", "b").unionByName(edges.select("frame_id", F.col("v").alias("c"), F.col("u").alias("to"), "sign", "w", "a", "b"))
    return both.groupBy("frame_id", "c").agg(F.min_by(F.struct("to", "sign"), F.struct(-F.col("w"), "a", "b")).alias("e")).select("frame_id", "c", "e.to", "e.sign")


def oriented(points: DataFrame, k: int = 16, k_orient: int = 4, steps: int | None = None, carried: bool = False, tile: int | None = None, halo: int | None = None) -> DataFrame:
    """(frame_id, pt_idx, nx, ny, nz, plane) of points(frame_id, pt_idx, x, y, z): oriented normals and the plane that each faces."""
    return turned(unoriented(points, k, k_orient, steps, carried, tile, halo))


def turned(rows: DataFrame) -> DataFrame:
    """(frame_id, pt_idx, nx, ny, nz, plane) of what unoriented() gives."""
    folder = scratch.shared(rows.sparkSession, "forest")
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    ends = rows.select("frame_id", F.col("pt_idx").alias("u"), *n, F.explode(F.expr("slice(nb, 2, size(nb))")).alias("v"))
    other = rows.select("frame_id", F.col("pt_idx").alias("v"), *(c.alias(f"o{i}") for i, c in enumerate(n)))
    dot = sum(c * F.col(f"o{i}") for i, c in enumerate(n))
    edges = ends.join(other, ["frame_id", "v"]).filter("u <> v").select("frame_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(dot < 0, -1).otherwise(1).alias("sign"), F.abs(dot).alias("w"))
    edges = scratch.written(edges.dropDuplicates(["frame_id", "u", "v"]).withColumns({"a": F.col("u"), "b": F.col("v")}), f"{folder}/edges0")
    names = scratch.written(rows.select("frame_id", "pt_idx", F.col("pt_idx").alias("c"), F.lit(1).alias("sign")), f"{folder}/names0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        roots = _roots(scratch.written(_best(edges), f"{folder}/best{turn}"), f"{folder}/roots{turn}")
        names = scratch.written(_renamed(names, roots, "c"), f"{folder}/names{turn}")
        edges = scratch.written(_renamed(_renamed(edges, roots, "u"), roots, "v").filter("u <> v"), f"{folder}/edges{turn}")
    seed = rows.select("frame_id", F.col("pt_idx").alias("c"), *(c.alias(f"s{i}") for i, c in enumerate(n)), "x", "y", "z")
    faces = seed.select("frame_id", "c", F.when(sum(F.col(f"s{i}") * F.col(c) for i, c in enumerate("xyz")) > 0, -1).otherwise(1).alias("flip"))  # towards the origin
    signed = names.join(faces, ["frame_id", "c"]).select("frame_id", "pt_idx", (F.col("sign") * F.col("flip")).alias("turn"))
    done = rows.join(signed, ["frame_id", "pt_idx"]).select("frame_id", "pt_idx", *((c * F.col("turn")).alias(name) for c, name in zip(n, ("nx", "ny", "nz"))))
    axes = [*n, *(-c for c in n)]
    return done.withColumn("plane", (F.array_position(F.array(*axes), F.array_max(F.array(*axes))) - 1).cast("int"))


def _renamed(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """rows whose column names its component's root now; sign is turned with it."""
    own = roots.select("frame_id", F.col("c").alias(column), F.col("root").alias("_root"), F.col("sign").alias("_sign"))
    joined = rows.join(own, ["frame_id", column], "left")
    return joined.withColumn("sign", F.col("sign") * F.coalesce("_sign", F.lit(1))).withColumn(column, F.coalesce("_root", column)).select(*rows.columns)


def _twice(up: DataFrame) -> DataFrame:
    """up(frame_id, c, to, sign) with ways twice as long; moved: whether the last half went on."""
    above = up.select("frame_id", F.col("c").alias("to"), F.col("to").alias("next"), F.col("sign").alias("more"))
    return up.join(above, ["frame_id", "to"]).select("frame_id", "c", F.col("next").alias("to"), (F.col("sign") * F.col("more")).alias("sign"), (F.col("next") != F.col("to")).alias("moved"))


def _roots(best: DataFrame, folder: str) -> DataFrame:
    """(frame_id, c, root, sign) of best(frame_id, c, to, sign): the smallest component of each tree, and the sign on the way to it.

    Every tree of best edges has one pair that chose each other (its best edge): the smaller of them ends the ways. Ways are doubled until none
    is left; then all of a tree are named after its smallest component.
    """
    back = best.select("frame_id", F.col("to").alias("c"), F.col("c").alias("to"), F.lit(True).alias("mutual"))
    up = best.join(back, ["frame_id", "c", "to"], "left").withColumn("end", F.coalesce("mutual", F.lit(False)) & (F.col("c") < F.col("to")))
    up = up.select("frame_id", "c", F.when(F.col("end"), F.col("c")).otherwise(F.col("to")).alias("to"), F.when(F.col("end"), 1).otherwise(F.col("sign")).alias("sign"))
    up, n = scratch.written(up, f"{folder}-0"), 0
    moved = True
    while moved:  # four times as far each time
        n += 1
        far = scratch.written(_twice(_twice(up)), f"{folder}-{n}")
        moved, up = not far.filter("moved").isEmpty(), far.drop("moved")
    least = up.groupBy("frame_id", "to").agg(F.min_by(F.struct("c", "sign"), "c").alias("m")).select("frame_id", "to", F.col("m.c").alias("root"), F.col("m.sign").alias("last"))
    return up.join(least, ["frame_id", "to"]).select("frame_id", "c", "root", (F.col("sign") * F.col("last")).alias("sign"))
