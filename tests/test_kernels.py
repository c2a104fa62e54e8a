"""Frame kernels, sources, container and streams: properties and round trips."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from cloudloom import params
from cloudloom.operators import atlas, container, fill, normals, refine, rounds, weave
from cloudloom.operators.components import grid_edges, smallest_reached
from cloudloom.operators.neighbors import nearest, stencil
from cloudloom.plans import derived, pipeline
from cloudloom.plans.kernels import PARAMETERS
from cloudloom.sources import ply
from cloudloom.streaming import gof
from cloudloom.streaming.sink import GroupTable

SF = "/root/testdata/sf0.001"


def test_stencil_counts():
    assert [sum(1 for o in stencil(9) if sum(c * c for c in o) == d) for d in range(1, 10)] == [6, 12, 8, 6, 24, 24, 0, 12, 30]


def test_nearest_against_all_distances():
    xyz = np.random.default_rng(1).integers(0, 30, (200, 3))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    want = np.array([np.lexsort((np.arange(200), row))[:9] for row in d])
    assert (nearest(xyz, 9) == want).all()
    assert (nearest(xyz[:2], 4)[:, 2:] == -1).all()


def test_components_are_those_of_all_pairs():
    r = np.random.default_rng(2)
    xyz, plane = np.unique(r.integers(0, 12, (300, 3)), axis=0), None
    plane = r.integers(0, 2, len(xyz))
    label = smallest_reached(len(xyz), *grid_edges(xyz, plane, 3))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    near = (d <= 3) & (plane[:, None] == plane[None])
    want = np.arange(len(xyz))
    for _ in range(len(xyz)):
        want = np.where(near, want[None], len(xyz)).min(1)
    assert (label == want).all()


def test_normals_of_a_plane():
    xyz = np.array([(x, y, 5) for x in range(16) for y in range(16)])
    found = nearest(xyz, 9)
    n = normals.orient(xyz, normals.principal_normals(xyz, found), found[:, :4])
    assert np.allclose(np.linalg.norm(n, axis=1), 1) and np.allclose(np.abs(n[:, 2]), 1)
    assert (normals.facing(n) == 5).all()  # towards the origin


def test_refinement_keeps_a_uniform_plane_and_heals_a_speck():
    xyz = np.array([(x, y, 0) for x in range(12) for y in range(12)])
    plane = np.full(len(xyz), 2)
    assert (refine.refine(xyz, plane, None, 1) == 2).all()
    plane[70] = 0
    assert (refine.refine(xyz, plane, np.tile([0.0, 0.0, 1.0], (len(xyz), 1)), 1) == 2).all()
    assert (refine.refine(np.array([[5, 5, 5]]), np.array([3]), None, 1) == 0).all()  # an isolated voxel


def test_patch_layers():
    rows = [(x, y, 10 + k) for x in range(8) for y in range(8) for k in (0, 2, 4, 5, 6)]
    frame = pd.DataFrame(rows, columns=list("xyz")).assign(frame_id=0, ppi=2)
    frame["pt_idx"] = range(len(frame))
    got = rounds.patches_of(frame, 16, propagation=6)
    first = got[got["patch_id"] == 0]
    assert (first["d1"] == 10).all() and (first["d2"] == 14).all() and len(first) == 64
    assert (got["d2"] - got["d1"]).between(0, 4).all()
    assert rounds.patches_of(frame, 10_000).empty


def frame_of(rows, ppi=2):
    frame = pd.DataFrame(rows, columns=list("xyz")).assign(frame_id=0, ppi=ppi)
    frame["pt_idx"] = range(len(frame))
    return frame


def test_points_behind_a_near_one_are_judged_by_their_distance_from_it():
    """A block's peak is 10; a pixel with 42 and 45 keeps both: 42 is 32 from the peak, 45 three behind 42."""
    rows = [(x, y, 10) for x in range(4) for y in range(4) if (x, y) != (1, 1)] + [(1, 1, 42), (1, 1, 45)]
    got = rounds.patches_of(frame_of(rows), 1, propagation=2000)
    own = got[(got["u"] == 1) & (got["v"] == 1)]
    assert own[["patch_id", "d1", "d2"]].values.tolist() == [[0, 42, 45]]
    # one deeper, and all points of the pixel wait for the next round
    got = rounds.patches_of(frame_of([(x, y, z + (z > 10)) for x, y, z in rows]), 1, propagation=2000)
    own = got[(got["u"] == 1) & (got["v"] == 1)]
    assert own["patch_id"].tolist() == [1] and (own["d1"] + own["min_d"]).tolist() == [43] and (own["d2"] + own["min_d"]).tolist() == [46]


def test_blocks_count_from_the_corner_of_a_patch():
    """Pixels 3 and 4 share a block of two if the patch begins at 3."""
    rows = [(3, 0, 0), (4, 0, 33), (5, 0, 33), (6, 0, 33)]
    got = rounds.patches_of(frame_of(rows), 1, propagation=2000, block=2)
    assert sorted(got[got["patch_id"] == 0]["u"]) == [3, 5, 6]  # 4 is 33 from the peak of its block


def test_deep_columns_and_two_layers():
    deep = frame_of([(x, 0, z) for x in range(3) for z in range(0, 400, 3)])
    got = rounds.patches_of(deep, 1, propagation=9)
    assert (got["d2"] - got["d1"]).between(0, 4).all() and got["d2"].max() <= 255
    single = rounds.patches_of(frame_of([(x, y, z) for x in range(4) for y in range(4) for z in (0, 2)]), 1, propagation=9, double=False)
    assert (single["d1"] == single["d2"]).all() and single["patch_id"].max() == 0


def test_groups_of_frames_with_gaps_and_too_wide_patches():
    patches = pd.DataFrame([(f, i, 0, 0, 0, w, 2) for f in (0, 1, 2) for i, w in enumerate((3, 40))], columns=["frame_id", "patch_id", "ppi", "u", "v", "w", "h"])
    for group in (patches, patches[patches["frame_id"] != 1]):
        got = atlas.pack_group(group.copy(), 16, 16, 1, 1, 0.3)
        assert {(f, i) for f, i, *_ in got} == set(zip(group["frame_id"], group["patch_id"]))
    fixed = atlas.pack_group(patches.assign(w=30, h=30), 16, 16, 1, 1, 0.3, grows=False)
    assert all(discarded for *_, discarded in fixed)


def test_placed_boxes_are_apart(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    rows = [(f, i, int(r.integers(0, 6)), int(r.integers(0, 20)), int(r.integers(0, 20)), int(r.integers(1, 9)), int(r.integers(1, 9))) for f in range(4) for i in range(12)]
    patches = spark.createDataFrame(rows, "frame_id int, patch_id int, ppi int, u int, v int, w int, h int")
    intra = patches.join(atlas.pack_intra(patches, 64, 64, 4), ["frame_id", "patch_id"]).toPandas()
    for _, f in intra.groupby("frame_id"):
        used = np.zeros((400, 16), int)
        for p in f.itertuples():
            w, h = (p.h, p.w) if p.swapped else (p.w, p.h)
            assert p.pos_x + w <= 16
            assert not used[max(0, p.pos_y - 1) : p.pos_y + h + 1, max(0, p.pos_x - 1) : p.pos_x + w + 1].any()
            used[p.pos_y : p.pos_y + h, p.pos_x : p.pos_x + w] = 1
    still = spark.range(3).select(F.col("id").cast("int").alias("frame_id")).crossJoin(patches.filter("frame_id = 0").drop("frame_id"))
    inter = atlas.pack_inter(still, 3, 64, 64, 4).toPandas()
    assert inter.groupby("patch_id")[["pos_x", "pos_y", "swapped"]].nunique().max().max() == 1
    fixed = atlas.pack_intra(patches, 16, 16, 4, grows=False).toPandas()
    assert fixed["discarded"].any()


def test_fills():
    image, occupancy = np.full((16, 16), 128, np.uint8), np.zeros((16, 16), bool)
    image[5, 5], occupancy[5, 5] = 40, True
    blocks = occupancy.reshape(4, 4, 4, 4).any((1, 3))
    assert (fill.dilate_blocks(image, blocks, 4)[4:8, 4:8] == 40).all()
    assert (fill.grow_blocks(image, occupancy, 8)[:8] == 40).all()
    pulled = fill.pull_push(image, occupancy)
    assert pulled[5, 5] == 40 and pulled.shape == image.shape
    left = fill.copy_left(np.arange(256, dtype=np.uint8).reshape(16, 16), np.eye(4, dtype=bool), 4)
    assert (left[0, 4:8] == 3).all() and (left[4, :4] == left[3, :4]).all()


def test_container_round_trip():
    patches = [{"pos_x": i, "pos_y": 3 * i, "size_x_minus1": i, "size_y_minus1": 0, "offset_u": 9, "offset_v": 700, "offset_d": 1, "range_d": 2, "plane": i % 6, "swapped": i % 2} for i in range(7)]
    sequence = container.payload(container.SEQUENCE_SET, container.sequence_values(64, 64, 15, 2))[1]
    frame = container.payload(container.FRAME_SET, {}, sequence)[1]
    data = container.tile_layer({"order": 1030}, [p | {"range_d": p["range_d"] + 256} for p in patches], frame, sequence)
    head, back = container.read_tile_layer(data, frame, sequence)
    assert [{k: b[k] for k in patches[0]} for b in back] == patches and head["order"] == 1030 % 1024 and head["type"] == container.TILE_I
    units = list(container.sub_units(container.sized([b"a", b"bb" * 300, b""])))
    assert units == [b"a", b"bb" * 300, b""]
    assert container.to_samples(b"\0\0\0\1ab\0\0\1c") == b"\0\0\0\2ab\0\0\0\1c"
    assert container.file_bytes([b"xyz"]) == bytes([128, 0, 0, 0, 0, 3]) + b"xyz"
    w = container.BitWriter()
    for v in (0, 1, 2, 3, 7, 8, 255, 65535):
        w.put_ue(v)
    w.trail()
    r = container.BitReader(w.bytes())
    assert [r.get_ue() for _ in range(8)] == [0, 1, 2, 3, 7, 8, 255, 65535]
    assert container.nal("ASPS", b"")[0] >> 1 == 36


def woven(points, axis=2):
    return weave.weave(*map(np.array, zip(*points)), axis)


def test_weaving_of_slices_worked_by_hand():
    """A chain keeps to the right of its steps, so it goes round a ring; planes are those that its steps face."""
    ring = [(a, b) for a in range(3) for b in range(3) if (a, b) != (1, 1)]
    planes, parents = woven(ring)
    assert dict(zip(ring, planes)) == {(0, 0): 4, (0, 1): 4, (0, 2): 0, (1, 2): 0, (2, 2): 1, (2, 1): 1, (2, 0): 3, (1, 0): 3} and not any(p is not None for p in parents)
    assert woven([(0, 0), (0, 3)]) == ([4, 4], [None, None])  # three apart is in reach
    assert woven([(0, 0), (0, 4)]) == ([0, 0], [None, None])  # four is not: two chains of one point
    assert woven([(0, 0), (1, 1), (2, 2)]) == ([4, 4, 3], [None] * 3)  # a diagonal step takes the plane before it, the last point looks home
    # (0, 1) and (1, 0) are as near: the first looked at goes on, the other is a child until the chain comes back for it
    assert woven([(0, 0), (0, 1), (1, 0)])[1] == [None, None, None]
    # three points in a row, seen from the middle of a chain that ends: (5, 6) stays a child of (5, 5)
    assert woven([(5, 5), (5, 5), (5, 6)])[1] == [None, 0, None]


def test_orders_of_places():
    assert len(weave._LISTS) == 28 + 4 + 4 and len({id(v) for v in weave._LISTS.values()}) == 36
    up = [place for _, *place in weave._LISTS[1, 0]]
    assert len(up) == 29 and up[:5] == [[0, 1], [1, 1], [0, 2], [1, 2], [1, 0]]
    right = [place for _, *place in weave._LISTS[0, 2]]
    assert right[:5] == [[-1, 0], [-1, 1], [-2, 0], [-2, 1], [0, 1]]
    assert [len(weave._LISTS[s]) for s in ((1, -1), (2, -1), (3, -1), (1, -2), (1, -3))] == [28, 24, 27, 27, 27]  # the third order has no place 25
    for step, places in weave._LISTS.items():
        assert all(0 < a * a + b * b <= 10 and d == weave.ring((a, b)) for d, a, b in places)


@pytest.mark.parametrize(
    ("home", "step", "move", "ends"),
    [((0, 1), (0, 1), (0, 2), True), ((0, 2), (1, 0), (0, 1), False), ((0, -1), (0, 1), (0, 1), False), ((1, 0), (1, 0), (1, 1), False), ((1, 1), (1, 0), (1, 0), True), ((-1, 0), (0, 1), (0, 1), True), ((-1, 1), (1, 0), (0, 1), True), ((1, 2), (1, 0), (0, 3), True), ((0, 3), (1, 0), (2, 2), False)],
)
def test_when_a_chain_ends(home, step, move, ends):
    assert weave.closes(home, step, move) == ends


def test_diagonaliser_with_a_step_limit():
    r = np.random.default_rng(5)
    m = r.standard_normal((500, 3, 3))
    a = m @ m.transpose(0, 2, 1)
    values, vectors = np.linalg.eigh(a)
    found, axes = normals.diagonalised(a, 30, carried=False)
    order = np.argsort(found, 1)
    assert np.allclose(np.take_along_axis(found, order, 1), values)
    same = np.abs(np.einsum("nij,nij->nj", np.take_along_axis(axes, order[:, None], 2), vectors))
    apart = np.diff(values, axis=1).min(1) > 0.05
    assert np.allclose(same[apart], 1, atol=1e-4)
    few = normals.diagonalised(a, 3, carried=False)[1]
    assert np.abs(np.abs(np.einsum("nij,nij->nj", few, axes)) - 1).max() > 0.01  # three looks are not enough for all
    for steps in (1, 4, 13):
        for carried in (True, False):
            found, axes = normals.diagonalised(a, steps, carried)
            assert np.allclose(axes @ axes.transpose(0, 2, 1), np.eye(3)) and np.allclose(found.sum(1), np.trace(a, axis1=1, axis2=2))
    assert np.allclose(normals.diagonalised(a, 1)[1], np.eye(3))  # one look and no turn
    # worked by hand: one element off the diagonal, equal ones beside it. The turn of 45 degrees has the half angle's sine s and cosine c; as the
    # product renews z first, w becomes c - s * s
    one = np.array([[[2.0, 1, 0], [1, 2, 0], [0, 0, 5]]])
    s_, c_ = np.sin(np.pi / 8), np.cos(np.pi / 8)
    angle = 2 * np.arctan2(s_, c_ - s_ * s_)
    found, axes = normals.diagonalised(one, 2)
    assert np.allclose(found[0], [2 + np.sin(2 * angle), 2 - np.sin(2 * angle), 5]) and np.allclose(axes[0, :2, 0], [np.cos(angle), np.sin(angle)])
    assert np.allclose(sorted(normals.diagonalised(one, 30, carried=False)[0][0]), [1, 3, 5])
    plane = np.array([(x, y, 5) for x in range(9) for y in range(9)])
    assert np.allclose(np.abs(normals.principal_normals(plane, nearest(plane, 6), 4)[:, 2]), 1)


def test_step_limits_of_the_presets():
    assert [params.resolve(d, n).diagonal_steps for d in (9, 10, 11) for n in ("fast", "slow")] == [4, 8, 4, 8, 8, 13]
    with pytest.raises(ValueError, match="diagonal_steps"):
        params.resolve(overrides="diagonal_steps=0")


def test_weaving_gives_every_point_a_plane_or_a_parent():
    ring = sorted({(int(20 + 12 * np.cos(t)), int(20 + 12 * np.sin(t))) for t in np.linspace(0, 6.3, 300)})
    a, b = map(np.array, zip(*ring))
    planes, parents = weave.weave(a, b, 2)
    assert all((p is None) != (q is None) for p, q in zip(planes, parents))
    assert {p for p in planes if p is not None} <= {0, 1, 3, 4}


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_formats(kind):
    columns = {"x": [1, 70000], "y": [2, 3], "z": [4, 5], "red": [7, 8], "green": [9, 300], "blue": [1, 2]}
    head = f"ply\nformat {kind} 1.0\nelement junk 1\nproperty list uchar int v\nelement vertex 2\n" + "".join(f"property int {c}\n" for c in columns) + "end_header\n"
    if kind == "ascii":
        body = b"2 5 6\n" + "\n".join(" ".join(str(columns[c][i]) for c in columns) for i in range(2)).encode() + b"\n"
    else:
        order = "<" if "little" in kind else ">"
        body = b"\2" + np.array([5, 6], order + "i4").tobytes() + np.array([[columns[c][i] for c in columns] for i in range(2)], order + "i4").tobytes()
    got = ply.cloud_of(head.encode() + body)
    assert got["x"].tolist() == [1, 70000 - 65536] and got["g"].tolist() == [9, 300 - 256]
    with pytest.raises(ValueError, match="vertex"):
        ply.parse(b"ply\nformat ascii 1.0\nelement face 0\nend_header\n")


def test_ply_files_round_trip(spark, tmp_path):
    pc = derived.cloud(spark, SF).filter("frame_id < 2")
    for r in ply.lines(pc).collect():
        (tmp_path / f"seq_{r['frame_id']:04d}.ply").write_text(r["value"])
    back = ply.read(spark, str(tmp_path), 6)
    assert back.exceptAll(pc.select(back.columns)).count() == 0 and back.count() == pc.count()


def test_stream_groups(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(7).selectExpr("cast(id as int) frame_id").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("frame_id int").parquet(str(source))
    got = []
    query = gof.each_group(gof.grouped_frames(stream, 3, idle_ms=500), lambda batch, i: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    end = time.time() + 60
    while len(got) < 3 and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert {(r["gof_id"], tuple(r["frames"]), r["complete"]) for r in got} == {(0, (0, 1, 2), True), (1, (3, 4, 5), True), (2, (6,), False)}


def test_a_stream_of_files_is_encoded_group_by_group(spark, tmp_path):
    """Two sequences of one folder, in any order, with a short last group each."""
    pc = derived.cloud(spark, SF).filter("frame_id < 3").persist()
    (tmp_path / "in").mkdir()
    for r in ply.lines(pc).collect():
        (tmp_path / "in" / f"s_{r['frame_id']:04d}.ply").write_text(r["value"])
        if r["frame_id"] == 1:
            (tmp_path / "in" / f"t {r['frame_id']:04d}.ply").write_text(r["value"])
    p = PARAMETERS.changed(gof_size=2, least_points=5, refine_sweeps=1)
    table = GroupTable(spark, str(tmp_path / "out"))
    query = gof.encode_stream(spark, str(tmp_path / "in"), p, table.out, files=2, idle_ms=500).option("checkpointLocation", str(tmp_path / "state")).start()
    end = time.time() + 200
    while table.committed().count() < 3 and time.time() < end:
        time.sleep(1)
    query.stop()
    got = table.units().collect()
    assert coded([r for r in got if r["sequence"] == "s-s_5f_"]) == encoded(pc, p)
    assert coded([r for r in got if r["sequence"] != "s-s_5f_"]) == encoded(pc.filter("frame_id = 1"), p)


def coded(rows):
    return sorted((r["gof_id"], r["unit_seq"], r["unit_type"], bytes(r["payload"])) for r in rows)


def encoded(points, p):
    tables = pipeline.encode(points, p)
    want = coded(pipeline.all_units(tables, p).collect())
    pipeline.release(tables)
    return want


def test_parameters():
    p = params.resolve(10, "slow", "AI", "16-22-4", "least_points=7,sliced=true")
    assert (p.geometry_qp, p.block, p.least_points, p.sliced, p.refine_reach, p.map_width) == (16, 4, 7, True, 9, 1024)
    assert params.preset(8, "fast")["refine_depth"] == 6 and params.preset(12, "slow")["map_width"] == 4096
    for bad in ({"overrides": "leest_points=3"}, {"overrides": "iou=2"}, {"rate": "1-2"}, {"name": "fastest"}, {"overrides": "iou=1,iou=1"}):
        with pytest.raises(ValueError):
            params.resolve(**bad)


def test_encode_whole(spark, tmp_path):
    pc = derived.cloud(spark, SF).filter("frame_id < 4")
    out = pipeline.encode(pc, PARAMETERS.changed(least_points=5, refine_sweeps=1))
    pixels = out["pixels"].toPandas()
    assert not pixels.duplicated(["frame_id", "patch_id", "u", "v"]).any() and (pixels["d2"] >= pixels["d1"]).all()
    units = out["units"].orderBy("gof_id", "unit_seq").collect()
    assert [u["unit_type"] for u in units] == ["VPS", "AD"] * 2
    pipeline.write_file(out["units"], str(tmp_path / "out.bin"))
    assert (tmp_path / "out.bin").stat().st_size == 1 + sum(5 + len(u["payload"]) for u in units)


def test_filtered_colour_of_a_flat_image():
    from cloudloom.operators.color import filtered_yuv

    y, u, v = filtered_yuv(np.full((16, 16, 3), (255, 0, 0), np.uint8))
    assert (y == round(0.2126 * 255)).all() and (np.abs(u.astype(int) - round(128 - 0.114572 * 255)) <= 1).all() and (v == 255).all() and u.shape == (8, 8)


def test_images_and_sinks(spark):
    from cloudloom.operators import codec
    from cloudloom.sources import sinks

    frame = pd.DataFrame({"frame_id": [0], "x": [3], "y": [5], "d1": [9], "d2": [11], "r": [1], "g": [2], "b": [3]})
    found = codec.images(frame, 16, 16, 2)
    assert found["occupancy"][0].sum() == 1 and [i[5, 3] for i in found["geometry"]] == [9, 11]
    assert found["geometry"][0][5, 2] == 9 and found["geometry"][0][5, 15] == 9 and found["geometry"][0][0, 0] == 128  # dilated, then copied to the right
    assert found["attribute"][0].shape == (24, 16) and found["attribute"][0][5, 3] == int(0.2126 * 1 + 0.7152 * 2 + 0.0722 * 3)
    rows = codec.video_units(spark.createDataFrame(frame), 2, 16, 16, 2).orderBy("unit_seq").collect()
    assert [(r["unit_type"], len(r["payload"])) for r in rows] == [("OVD", 4 + 64), ("GVD", 4 + 512), ("AVD", 4 + 768)]
    few = codec.images(frame, 16, 16, 4, threshold=2, fill_="pushPull")
    assert not few["occupancy"][0].any()  # one pixel of sixteen is under the threshold
    image = sinks.raw_image(spark.createDataFrame(frame), 16, 16, "d1").first()["image"]
    assert len(image) == 256 and image[5 * 16 + 3] == 9 and sum(image) == 9
    assert sinks.repacked(b"rrggbb") == b"rgbrgb"
    w = container.BitWriter()
    w.structure(container.NAL_HEADER, {"type": 36})
    w.put_ue(4, "five")
    assert sinks.trace_lines(w)[1] == "type u(6) : 36" and sinks.trace_lines(w)[-1] == "five ue(v) : 4"


def test_command_line(capsys):
    from cloudloom.__main__ import main

    main(["-i", "x_vox9_%04d.ply", "-o", "y", "-p", "slow", "-r", "16-22-2", "-d"])
    assert "gof_size=8" in capsys.readouterr().out


def test_command_line_reads_patterns_and_loops(spark, tmp_path):
    import argparse

    from cloudloom import __main__ as cli

    for f in (3, 4, 5):
        (tmp_path / f"s_vox6_{f:04d}.ply").write_text(f"ply\nformat ascii 1.0\nelement vertex 1\nproperty int x\nproperty int y\nproperty int z\nproperty int red\nproperty int green\nproperty int blue\nend_header\n{f} 1 2 3 4 5\n")
    args = lambda **own: argparse.Namespace(**{"input": str(tmp_path / "s_vox6_%04d.ply"), "frames": 2, "start_frame": 4, "loop_input": 3} | own)
    got = sorted((r["frame_id"], r["x"]) for r in cli.read(spark, args(), 6).collect())
    assert got == [(0, 4), (1, 5), (2, 4), (3, 5), (4, 4), (5, 5)]
    assert sorted(r["x"] for r in cli.read(spark, args(input=str(tmp_path), frames=1, start_frame=3), 6).collect()) == [3]


def test_descriptions_taps_statistics_and_low_delay(spark, tmp_path):
    from cloudloom.sources import sdp, sinks, taps

    pc = derived.cloud(spark, SF).filter("frame_id < 4")
    p = PARAMETERS.changed(least_points=5, refine_sweeps=1, low_delay=True, voxel_depth=5, refine_depth=4)
    tables = pipeline.encode(pc, p)
    units = pipeline.all_units(tables, p).cache()
    got = [(r["gof_id"], r["unit_type"]) for r in units.orderBy("gof_id", "unit_seq").collect()]
    assert got == [(0, "VPS"), *[(0, t) for _ in range(3) for t in ("AD", "OVD", "GVD", "AVD")], (1, "VPS"), (1, "AD"), (1, "OVD"), (1, "GVD"), (1, "AVD")]
    texts = {r["unit_type"]: r["text"] for r in sdp.descriptions(units).collect()}
    assert set(texts) == {"AD", "OVD", "GVD", "AVD"} and texts["OVD"].startswith("m=video 8892 RTP/AVP 96\na=rtpmap:96 H265/90000\na=v3cfmtp:sprop-v3c-unit-header=")
    looks = taps.taps(tables)
    assert looks["planes"].select("r", "g", "b").distinct().count() == 6
    stats = pipeline.statistics(tables, p).orderBy("frame_id").collect()
    assert [r["points"] for r in stats] == [r["n"] for r in pc.groupBy("frame_id").count().withColumnRenamed("count", "n").orderBy("frame_id").collect()]
    assert [r["lost_points"] for r in stats] == [looks["lost"].filter(f"frame_id = {i}").count() for i in range(4)]
    sinks.write_statistics(pipeline.statistics(tables, p), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 4
    groups = spark.createDataFrame([(0, 10.0, 3), (1, 12.0, 3)], "gof_id int, done double, frames int")
    assert [(r["delay"], r["fps"]) for r in sinks.delays(groups).orderBy("gof_id").collect()] == [(None, None), (2.0, 1.5)]
