"""Normals of frames in tiles against the kernels that see a whole frame."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import normals, tiles
from cloudloom.operators.neighbors import nearest

POINTS = "frame_id int, pt_idx int, x int, y int, z int"


def frame(spark, clouds):
    rows = [(f, i, *map(int, p)) for f, xyz in clouds.items() for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, POINTS).withColumns({c: F.lit("x") for c in ("own", "tx", "c", "sign", "u")}).repartition(3)


def shell(radius, at):
    axis = range(-radius - 1, radius + 2)
    return np.array([(x, y, z) for x in axis for y in axis for z in axis if radius - 1 <= np.sqrt(x * x + y * y + z * z) < radius]) + at


def test_asked_points_only():
    xyz = np.random.default_rng(3).integers(0, 20, (150, 3))
    some = np.array([3, 77, 149])
    assert (nearest(xyz, 5, asked=some)[some] == nearest(xyz, 5)[some]).all()


@pytest.mark.parametrize(("tile", "halo"), [(8, 2), (64, 4)])
def test_neighbours_of_tiles_are_those_of_the_frame(spark, tile, halo):
    """Scattered points, so that some need several halos; a far point; two frames; fewer points than neighbours."""
    r = np.random.default_rng(4)
    clouds = {0: np.vstack([r.integers(0, 40, (250, 3)), [[200, 3, 3]]]), 5: r.integers(10, 30, (120, 3)), 6: np.array([[1, 2, 3], [1, 2, 3], [60, 0, 0]])}
    got = {(x["frame_id"], x["pt_idx"]): x for x in tiles.unoriented(frame(spark, clouds), 6, 4, tile=tile, halo=halo).collect()}
    assert len(got) == sum(map(len, clouds.values()))
    for f, xyz in clouds.items():
        found = nearest(xyz, 6)
        n = normals.principal_normals(xyz, found)
        for i in range(len(xyz)):
            assert list(got[f, i]["nb"]) == [int(j) for j in found[i, :4] if j >= 0]
            assert np.allclose([got[f, i][c] for c in ("nx", "ny", "nz")], n[i])


def test_orientation_is_that_of_the_whole_frame(spark):
    """Two shells of different sizes in one frame, one in another: turned alike over all tiles, each as a growth from its first point turns it."""
    clouds = {1: np.vstack([shell(6, (20, 20, 20)), shell(5, (60, 25, 30))]), 2: shell(7, (15, 15, 15))}
    points = frame(spark, clouds)
    got = {(r["frame_id"], r["pt_idx"]): r for r in tiles.oriented(points, 12, 6, tile=10, halo=2).collect()}
    want = normals.with_normals(points, 12, 6).collect()
    assert len(got) == len(want)
    for r in want:
        own = got[r["frame_id"], r["pt_idx"]]
        assert np.allclose([own[c] for c in ("nx", "ny", "nz")], [r[c] for c in ("nx", "ny", "nz")]) and own["plane"] == r["plane"]


def test_lone_points_and_none(spark):
    one = tiles.oriented(frame(spark, {0: [[5, 5, 5]], 1: [[1, 1, 1], [90, 90, 90]]}), 4, 3).collect()
    assert len(one) == 3 and all(0 <= r["plane"] <= 5 for r in one)
    assert tiles.oriented(spark.createDataFrame([], POINTS)).count() == 0


def test_roots_of_chains(spark):
    """A way through a tree of best edges multiplies the signs along it."""
    rows = [(0, i, i + 1, -1 if i % 3 == 0 else 1) for i in range(1, 40)] + [(0, 40, 39, 1)] + [(1, 7, 8, -1), (1, 8, 7, -1)]
    from cloudloom.sources import scratch

    got = {(r["frame_id"], r["c"]): (r["root"], r["sign"]) for r in tiles._roots(spark.createDataFrame(rows, "frame_id int, c int, to int, sign int"), scratch.shared(spark, "roots")).collect()}
    sign = 1
    for i in range(1, 41):
        assert got[0, i] == (1, sign)
        sign *= -1 if i % 3 == 0 and i < 39 else 1
    assert got[1, 7] == (7, 1) and got[1, 8] == (7, -1)
