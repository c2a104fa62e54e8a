"""Numbered frames as a stream, groups that are taken once, coded files written in parallel."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloudloom.operators import container
from cloudloom.plans import derived
from cloudloom.plans.kernels import PARAMETERS
from cloudloom.sources import frame_stream, ply, v3c_file
from cloudloom.streaming import gof
from cloudloom.streaming.sink import GroupTable, key

from test_kernels import SF, coded, encoded


def rows_of(reader, start=None):
    """All that a reader gives until it stands still, as batches of (frame_id, gof_id, of_group)."""
    at, out = start or reader.initialOffset(), []
    while True:
        rows, now = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, now))  # a batch that is read again is the same
        if now == at:
            return out, at
        out.append([r[1:4] for r in rows])
        at = now


def test_frames_of_known_number():
    reader = frame_stream.FrameReader({"pattern": "/x/s_%04d.ply", "frames": "5", "start": "7", "size": "4", "limit": "3"})
    batches, end = rows_of(reader)
    assert batches == [[(0, 0, 4), (1, 0, 4), (2, 0, 4)], [(3, 0, 4), (4, 1, 1)]] and end == {"frame": 5, "ended": True}
    assert reader.path(4) == "/x/s_0011.ply" and reader.sequence == "s_"
    assert rows_of(frame_stream.FrameReader({"pattern": "p%d", "frames": "0"}))[0] == []


def test_loops():
    reader = frame_stream.FrameReader({"pattern": "p%d", "frames": "3", "loops": "2", "size": "4", "start": "1"})
    batches, _ = rows_of(reader)
    assert [b for own in batches for b in own] == [(0, 0, 4), (1, 0, 4), (2, 0, 4), (3, 0, 4), (4, 1, 2), (5, 1, 2)] and reader.path(4) == "p2"
    endless = frame_stream.FrameReader({"pattern": "p%d", "frames": "3", "loops": "0", "size": "4", "limit": "5"})
    rows, now = endless.read({"frame": 10**6, "ended": False})
    assert len(list(rows)) == 5 and now == {"frame": 10**6 + 5, "ended": False}
    with pytest.raises(ValueError, match="number of frames"):
        frame_stream.FrameReader({"pattern": "p%d", "loops": "0"})


def test_frames_that_arrive_and_an_end_mark(tmp_path):
    options = {"pattern": f"{tmp_path}/f%d.ply", "size": "2", "end": f"{tmp_path}/end", "limit": "10"}
    reader = frame_stream.FrameReader(options)
    assert rows_of(reader) == ([], {"frame": 0, "ended": False})
    for i in (0, 1, 2, 4):  # 3 is missing
        (tmp_path / f"f{i}.ply").touch()
    batches, at = rows_of(reader)
    assert batches == [[(0, 0, 2), (1, 0, 2), (2, 1, 2)]] and not at["ended"]
    (tmp_path / "f3.ply").touch()
    (tmp_path / "end").touch()
    batches, at = rows_of(reader, at)
    assert batches == [[(3, 1, 2), (4, 2, 2), (None, 2, 1)]] and at == {"frame": 5, "ended": True}
    assert rows_of(reader, at) == ([], at)


def drain(query, seconds=120):
    end = time.time() + seconds
    while query.isActive and time.time() < end:
        time.sleep(0.2)
    assert not query.isActive and query.exception() is None


def test_eighteen_frames_in_groups_of_sixteen(spark, tmp_path):
    """availableNow gives the whole group and the short one at once, and stops; a second run finds nothing left."""
    got = []
    for _ in range(2):
        stream = frame_stream.frames(spark, "/nowhere/a_%d.ply", frames=18, size=16)
        began = time.time()
        writer = gof.each_group(gof.grouped_frames(stream, 16, idle_ms=None), lambda batch, i: got.extend(batch.collect()))
        drain(writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert [(r["gof_id"], list(r["frames"]), r["complete"]) for r in got] == [(0, [*range(16)], True), (1, [16, 17], True)]
    assert got[1]["paths"] == ["/nowhere/a_16.ply", "/nowhere/a_17.ply"] and got[0]["sequence"] == "a_"


def test_a_limited_stream_goes_on_where_it_was(spark, tmp_path):
    """Three frames a batch; stopped and started again, each group comes once."""
    got = []
    for n in (1, 4):
        stream = frame_stream.frames(spark, "/nowhere/a_%d.ply", frames=10, size=4, limit=3)
        query = gof.each_group(gof.grouped_frames(stream, 4, idle_ms=None), lambda batch, i: got.extend(batch.collect()), 0.1).option("checkpointLocation", str(tmp_path / "state")).start()
        end = time.time() + 90
        while len(got) < min(n, 3) and time.time() < end:
            time.sleep(0.2)
        query.stop()
    assert sorted((r["gof_id"], len(r["frames"])) for r in got) == [(0, 4), (1, 4), (2, 2)]


def test_numbered_frames_are_encoded_in_loops(spark, tmp_path):
    pc = derived.cloud(spark, SF).filter("frame_id < 2").persist()
    pattern = ply.write_numbered(pc, str(tmp_path / "in"))
    p = PARAMETERS.changed(gof_size=3, least_points=5, refine_sweeps=1, in_flight=3)
    table = GroupTable(spark, str(tmp_path / "out"))
    writer = gof.encode_frames(spark, pattern, p, table.out, frames=2, loops=2)
    drain(writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(), 200)
    looped = pc.withColumn("frame_id", F.explode(F.array("frame_id", F.col("frame_id") + 2)))
    assert coded(table.units().collect()) == encoded(looped, p)
    assert sorted((r["gof_id"], r["frames"]) for r in table.committed().collect()) == [(0, 3), (1, 1)]


def group(sequence, gof_id, frames):
    return Row(sequence=sequence, gof_id=gof_id, frames=frames, paths=["p"] * len(frames), complete=True)


def test_replayed_batches_and_late_frames(spark, tmp_path):
    """A batch that comes again changes nothing, one that was lost before its commit is done over, a closed group stays as it is."""
    table, seen = GroupTable(spark, str(tmp_path / "out")), []

    def encode(sequence, groups, take, fail=None):
        seen.append((sequence, [g["gof_id"] for g in groups]))
        rows = [(g["gof_id"], i, "AD", f"{sequence}{g['frames']}{i}".encode()) for g in groups for i in range(2)]
        take(spark.createDataFrame(rows, "gof_id long, unit_seq int, unit_type string, payload binary"))
        if fail:
            raise RuntimeError(fail)

    first = [group("a_", 0, [0, 1]), group("a_", 1, [2]), group("b", 0, [0]), group("", 0, [5])]
    table.add(first, 0, encode, 2)
    assert seen == [("", [0]), ("a_", [0]), ("a_", [1]), ("b", [0])]  # at most two frames at once
    state = coded(table.units().collect())
    table.add(first, 0, encode, 2)
    assert len(seen) == 4 and coded(table.units().collect()) == state and len(state) == 8
    with pytest.raises(RuntimeError):
        table.add([group("a_", 2, [4, 5])], 1, lambda *a: encode(*a, fail="lost"), 64)
    assert coded(table.units().collect()) == state  # not committed, so not seen
    table.add([group("a_", 2, [4])], 1, encode, 64)
    assert [r[3] for r in coded(table.units().collect()) if r[0] == 2] == [b"a_[4]0", b"a_[4]1"]
    table.add([group("a_", 1, [3]), group("a_", 3, [6])], 2, encode, 64)
    assert seen[-1] == ("a_", [3]) and [(r["gof_id"], list(r["frames"]), r["batch_id"]) for r in table.late().collect()] == [(1, [3], 2)]
    assert len(coded(table.units().collect())) == len(state) + 4
    assert len({key(n) for n in ("a/b", "a_b", "a=b", "a b", "", "_", "a_2f_b")}) == 7


UNITS = "gof_id long, unit_seq int, unit_type string, payload binary"


@pytest.mark.parametrize("part_bytes", [None, 100, 7])
def test_a_file_in_parallel_is_the_file(spark, tmp_path, part_bytes):
    rows = [(g, s, "AD", bytes([(g * 7 + s * i) % 256 for i in range((g * s) % 40)])) for g in range(12) for s in range(5)] + [(3, 9, "AD", None), (3, 9, "AD", b"x"), (3, 9, "AD", b"x")]
    units = spark.createDataFrame(rows, UNITS).repartition(7)
    want = container.file_bytes([r[3] or b"" for r in sorted(rows, key=lambda r: (r[0], r[1], len(r[3] or b"")))])
    at = str(tmp_path / "whole.bin")
    assert v3c_file.write(units, at, part_bytes) == len(want)
    assert open(at, "rb").read() == want
    assert v3c_file.write_parts(units, str(tmp_path / "parts"), part_bytes) == len(want)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*"))) == want
    folder = str(tmp_path / "index")
    index = v3c_file.places(v3c_file.staged(units, folder), folder, 3)
    back = v3c_file.read_units(index, at).collect()
    assert sorted((r["gof_id"], r["unit_seq"], bytes(r["payload"])) for r in back) == sorted((r[0], r[1], r[3] or b"") for r in rows)


def test_a_file_of_no_units(spark, tmp_path):
    assert v3c_file.write(spark.createDataFrame([], UNITS), str(tmp_path / "f")) == 1 and (tmp_path / "f").read_bytes() == container.file_bytes([])


@pytest.mark.parametrize("more", [["-n", "3"], ["--end-mark", "END"]])
def test_command_line_streams(spark, tmp_path, capsys, more):
    from cloudloom.__main__ import main

    pc = derived.cloud(spark, SF).filter("frame_id < 3").persist()
    for r in ply.lines(pc).collect():
        (tmp_path / f"s_{r['frame_id']:04d}.ply").write_text(r["value"])
    (tmp_path / "END").touch()
    more = [str(tmp_path / m) if m == "END" else m for m in more]
    own = "voxel_depth=6,refine_depth=5,gof_size=2,map_width=128,map_height=128,least_points=5,refine_sweeps=1"
    main(["-i", str(tmp_path / "s_%04d.ply"), "-o", str(tmp_path / "out"), "-s", "0", "-g", "6", "--stream", "--set", own, *more])
    from cloudloom.params import resolve

    table = GroupTable(spark, str(tmp_path / "out"))
    assert sorted((r["gof_id"], r["frames"]) for r in table.committed().collect()) == [(0, 2), (1, 1)]
    assert coded(table.units().collect()) == encoded(pc, resolve(6, overrides=own))
    with pytest.raises(SystemExit):
        main(["-i", str(tmp_path / "s_%04d.ply"), "-o", "x", "-g", "6", "--stream"])


def test_written_normals_and_images(spark):
    from cloudloom.sources import sdp, sinks

    points = spark.createDataFrame([(0, 1, 4, 5, 6, 7, 8, 9, 0.5, -1.0, 0.25), (0, 0, 1, 2, 3, 4, 5, 6, 0.0, 0.0, 1.0)], "frame_id int, pt_idx int, x int, y int, z int, r int, g int, b int, nx double, ny double, nz double")
    text = ply.lines(points).first()["value"]
    assert text.count("property") == 9 and text.endswith("end_header\n1 2 3 4 5 6 0.000000 0.000000 1.000000\n4 5 6 7 8 9 0.500000 -1.000000 0.250000\n")
    assert ply.parse(text.encode())["ny"].tolist() == [0.0, -1.0] and "nx" not in ply.lines(points.drop("nx", "ny", "nz")).first()["value"]
    spots = [(0, 3, 1, 200), (0, 0, 0, 7), (0, 4, 1, 1), (0, 4, 1, 9), (1, 0, 2, 255)]
    images = {r["frame_id"]: bytes(r["image"]) for r in sinks.raw_image(spark.createDataFrame(spots, "frame_id int, x int, y int, v int"), 5, 4, "v", 2).collect()}
    for f in (0, 1):
        want = bytearray([2] * 20)
        for g, x, y, v in spots:
            if g == f:
                want[5 * y + x] = v
        assert images[f] == bytes(want)
    assert "c=IN IP4 10.0.0.1\n" in sdp.description("AD", 1, b"", b"", address="10.0.0.1") and "c=IN IP6 ::1" in sdp.description("AD", 1, b"", b"", address="::1") and "c=" not in sdp.description("AD", 1, b"", b"")
