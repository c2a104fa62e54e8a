"""Published parameter names, encoding frame by frame, counters of sweeps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom import params
from cloudloom.operators import refine
from cloudloom.operators.codec import RawCodec
from cloudloom.plans import derived, pipeline
from cloudloom.plans.kernels import PARAMETERS
from cloudloom.session import Encoder

from test_kernels import SF, coded, encoded


def test_published_names():
    assert len(params.PUBLISHED) == 78
    known = set(params.Parameters.__dataclass_fields__)
    assert {n.field for n in params.PUBLISHED.values() if n.field} <= known
    p = params.resolve(10, overrides="sizeGOF=8,mapWidth=512,minimumMapHeight=512,interPatchPacking=false,gpaTresholdIoU=0.5,activateSlicing=true,geometryEncodingPreset=slow,maxConcurrentFrames=0,rate=32-42-4")
    assert (p.gof_size, p.map_width, p.mode, p.iou, p.sliced, p.in_flight, p.geometry_qp, p.attribute_qp, p.block) == (8, 512, "AI", 0.5, True, 32, 32, 42, 4)
    assert p.codec_options("geometry") == {"Mode": "AI", "sizeGOF": 8, "Preset": "slow", "Qp": 32} and "Qp" not in p.codec_options("occupancy")
    assert params.resolve(9, overrides="presetName=slow,mode=AI").diagonal_steps == 8


@pytest.mark.parametrize(
    ("overrides", "message"),
    [
        ("sizeGof=8", "did you mean sizeGOF"), ("sizeGOF=9", "none of 8, 16"), ("mapWidth=-8", "no number from 0 on"), ("mapWidth=", "empty"), ("doubleLayer=yes", "no boolean"), ("gpaTresholdIoU=1.5", "iou is 0 to 1"),
        ("gpaTresholdIoU=half", "no number"), ("sizeGOF=8,gof_size=8", "given twice"), ("sizeGOF=8,sizeGOF=8", "given twice"), ("intraFramePeriod=60", "multiple"), ("exportStatistics=1", "folder"), ("occupancyEncodingIsLossless=0", "loss"),
        ("occupancyEncodingFormat=YUV400", "YUV420"), ("lowDelayBitstream=true", "encoderInfoSEI"), ("maxConcurrentFrames=8", "in_flight"), ("mapWidth=1000,occupancyMapDSResolution=4", "sides"), ("maxAllowedDist2RawPointsDetection=10", "steps"),
    ],
)
def test_values_that_are_refused(overrides, message):
    with pytest.raises(ValueError, match=message):
        params.resolve(10, overrides=overrides)


def test_values_that_go_together():
    assert params.resolve(overrides="lowDelayBitstream=true,encoderInfoSEI=1").low_delay
    assert params.resolve(overrides="exportStatistics=1,statisticsDir=/tmp/x").others == (("exportStatistics", True), ("statisticsDir", "/tmp/x"))


def test_frames_one_at_a_time(spark):
    """The same units as of all frames at once; a short last group comes by flush()."""
    pc = derived.cloud(spark, SF).filter("frame_id < 3").persist()
    encoder = Encoder(spark)
    for name in ("voxel_depth=6", "refine_depth=5", "gof_size=2", "map_width=128", "map_height=128", "least_points=5", "refine_sweeps=1", "geoBitDepthInput=6"):
        encoder.set(*name.split("="))
    with pytest.raises(RuntimeError, match="initialise"):
        encoder.encode_frame(pc)
    p = encoder.initialise()
    with pytest.raises(RuntimeError, match="after"):
        encoder.set("mapWidth", "256")
    got, groups = [], []
    for f in range(3):
        units = encoder.encode_frame(pc.filter(F.col("frame_id") == f))
        groups.append(units is not None)
        got += units.collect() if units is not None else []
    last = encoder.flush().collect()
    assert groups == [False, True, False] and encoder.flush() is None and coded(got + last) == encoded(pc, p)
    encoder.stop()
    with pytest.raises(RuntimeError, match="stop"):
        encoder.encode_frame(pc)


def test_a_codec_is_told_its_options(spark):
    class Told(RawCodec):
        def __init__(self, options=None):
            self.options = options

        def configured(self, options):
            return Told(options)

        def encode(self, kind, images):
            return repr(sorted(self.options[kind].items())).encode()

    pc = derived.cloud(spark, SF).filter("frame_id < 1")
    p = PARAMETERS.changed(least_points=5, refine_sweeps=1, others=(("attributeEncodingPreset", "slow"), ("sizeGOP2DEncoding", 8)))
    tables = pipeline.encode(pc, p)
    by = {r["unit_type"]: bytes(r["payload"])[4:].decode() for r in pipeline.all_units(tables, p, Told()).collect() if r["unit_type"] in ("OVD", "GVD", "AVD")}
    assert by["AVD"] == repr([("Mode", "RA"), ("Preset", "slow"), ("Qp", 42), ("sizeGOF", 3), ("sizeGOP2DEncoding", 8)]) and "Qp" not in by["OVD"] and "('Qp', 32)" in by["GVD"]
    pipeline.release(tables)


def test_setting_twice(spark):
    for fatal in ("true", "false"):
        encoder = Encoder(spark)
        for name, value in (("geoBitDepthInput", "9"), ("sizeGOF", "8"), ("sizeGOF", "16"), ("errorsAreFatal", fatal)):
            encoder.set(name, value)
        if fatal == "true":
            with pytest.raises(ValueError, match="already"):
                encoder.initialise()
        else:
            assert encoder.initialise().gof_size == 8
    with pytest.raises(ValueError, match="geoBitDepthInput"):
        Encoder(spark).initialise()


def test_counters_of_sweeps():
    """A flat sheet with one strange point, voxels of one point each: worked by hand."""
    xyz = np.array([(x, y, 0) for x in range(5) for y in range(5)])
    plane = np.full(25, 2)
    plane[12] = 0
    log = []
    out = refine.refine(xyz, plane, None, 0, reach=2, indirect=2, weight=3.5, sweeps=2, log=log)
    assert (out == 2).all()
    first, second = log
    assert first["skipped_voxels"] == 0 and first["single_edge"] == 25 and first["no_edge"] == first["multi_edge"] == first["indirect_edge"] == 0
    # the eight around the strange one see two planes; the strange one sees one plane, but not its own; all others are settled
    assert first["score_computations"] == first["single_edge_refined"] == 9 and first["plane_changes"] == 1
    assert second["score_computations"] == second["plane_changes"] == 0
    block = np.array([(x, y, 0) for x in range(8) for y in range(8)])
    log = []
    refine.refine(block, np.full(64, 2), None, 1, sweeps=1, log=log)
    assert log == [{**dict.fromkeys(refine.COUNTERS, 0), "skipped_voxels": 16, "no_edge": 16}]
