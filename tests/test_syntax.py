"""The container's grammar: hand-worked bits, conditions, and what is written is read."""

import random

import pytest
from pyspark.sql import functions as F

from cloudloom.operators import container, syntax
from cloudloom.operators.syntax import UE, Item, Many
from cloudloom.plans import derived, kernels, pipeline

UNSUPPORTED = {"plr", "vui", "miv_extension", "frame_miv_extension", "packing"}


def drawn(grammar, rng, *around):
    """Random values of a structure, as the grammar's conditions ask for them."""

    def exchange(item, code, _):
        if item.name in UNSUPPORTED or item.name in ("extension_6bits", "extension_7bits") and grammar is not container.PARAMETER_SET:
            return 0
        return rng.randrange(4) if code == UE else min(rng.getrandbits(code), 3) if code else 0

    return syntax.walk(grammar, exchange, None, *around)


def ue(n):
    return format(n + 1, "b").zfill(2 * (n + 1).bit_length() - 1)


def test_hand_worked_bits():
    sequence = "".join([ue(0), ue(128), ue(64), f"{10:05b}", f"{7:05b}", ue(6), ue(0), "0", ue(1), ue(1), ue(1), "1", "0", "0", "1", "1", "0", "010", "0", "0001", "0", "0", "0", "0", "0", "1", "1", "0", "000000", "1"])
    data, full = container.payload(container.SEQUENCE_SET, container.sequence_values(128, 64, 10, 2, 4))
    assert "".join(f"{b:08b}" for b in data) == sequence + ("1" + "0" * (-(len(sequence) + 1) % 8) if len(sequence) % 8 else "")
    assert container.payload(container.FRAME_SET, {"extension": 1}, full)[0] == bytes([0b11100110, 0b01000000, 0b00100000])
    w = container.BitWriter()
    w.structure(container.TILE_HEADER, {"order": 3, "min_d_quantiser": 6, "delta_quantiser": 6}, {"nal": 23}, container.payload(container.FRAME_SET, {}, full)[1], full)
    assert [(name, value) for name, _, _, value in w.trace] == [("no_prior_output", 0), ("frame_set", 0), ("adaptation_set", 0), ("tile", 0), ("type", 1), ("order", 3), ("by_list", 1), ("min_d_quantiser", 6), ("delta_quantiser", 6)]
    w = container.BitWriter()
    w.structure(container.PATCH, {"pos_x": 1, "offset_u": 700, "range_d": 3, "plane": 5, "swapped": 1}, {"min_d_quantiser": 6, "delta_quantiser": 6}, full)
    assert "".join(f"{b:08b}" for b in w.bytes()).startswith(ue(1) + ue(0) * 3 + f"{700:011b}" + "0" * 11 + "00000" + "11" + "101" + "1")
    data = container.payload(container.PARAMETER_SET, container.parameter_values(17, 128, 64, 10, 1, {"attribute": 9}))[0]
    head = "0" + f"{1:07b}" + f"{1:08b}" * 2 + "0" * 16 + "1111" + "1" * 12 + f"{30:08b}" + "0" * 8 + "0001" + "0" * 8 + "0" * 6 + "0" * 6 + ue(128) + ue(64) + "0000" + "0111" + f"{1:08b}" + "0" * 8 + "00111" + "0"
    assert "".join(f"{b:08b}" for b in data).startswith(head + f"{1:08b}" + "00111" + "0" + f"{10:05b}" + f"{1:07b}" + "0000" + f"{9:08b}" + f"{2:06b}" + "0" * 6 + "00111" + "0" + "0")


def test_whatever_is_written_is_read():
    rng, seen, tiles = random.Random(5), set(), 0
    for _ in range(400):
        sequence = drawn(container.SEQUENCE_SET, rng)
        sets = [(container.PARAMETER_SET, drawn(container.PARAMETER_SET, rng), ()), (container.SEQUENCE_SET, sequence, ())]
        frame = drawn(container.FRAME_SET, rng, sequence)
        sets.append((container.FRAME_SET, frame, (sequence,)))
        for grammar, values, around in sets:
            data, full = container.payload(grammar, values, *around)
            assert container.BitReader(data).structure(grammar, *around) == values == full
            seen |= {(id(grammar), k) for k, v in values.items() if v}
        try:
            header = drawn(container.TILE_HEADER, rng, {"nal": 23}, frame, sequence)
            patches = [drawn(container.PATCH, rng, header, frame, sequence) for _ in range(3)]
        except ValueError:  # a list that the sequence set does not have, or a quantiser of more bits than the depth
            continue
        if header["type"] == container.TILE_I:
            tiles += 1
            got = container.read_tile_layer(container.tile_layer(header, patches, frame, sequence), frame, sequence)
            assert got == (header, patches)
    assert tiles > 20
    for grammar in (container.PARAMETER_SET, container.SEQUENCE_SET, container.FRAME_SET):
        could = {x.name for x in grammar if not (isinstance(x, Item) and x.code is None)} - UNSUPPORTED - {"extension_7bits", "extension_6bits"}
        assert could <= {k for g, k in seen if g == id(grammar)}, "every flag is set at least once"


def test_nothing_is_lost_in_silence():
    write = lambda values: container.payload(container.SEQUENCE_SET, values)
    with pytest.raises(ValueError, match="projections_minus1 is 3"):
        write({"projections_minus1": 3})
    with pytest.raises(ValueError, match="no such elements: widht"):
        write({"widht": 3})
    with pytest.raises(ValueError, match="log2_block does not take 8"):
        write({"log2_block": 8})
    with pytest.raises(ValueError, match="2 given, 1 coded"):
        write({"list_count": 1, "reference_lists": [{}, {}]})
    with pytest.raises(NotImplementedError, match="plr_information"):
        write({"plr": 1})
    with pytest.raises(ValueError, match="end within"):
        container.BitReader(b"\x80").structure([Item("a", 9)])
    with pytest.raises(ValueError, match="end within"):
        container.BitReader(b"\0").structure([Many("a", lambda s: 1, (Item("b", UE),))])


def test_long_streams_of_bits():
    rng, w = random.Random(1), container.BitWriter()
    put = [(rng.getrandbits(b), b) for b in (rng.randrange(1, 33) for _ in range(5000))]
    for v, b in put:
        w.put(v, b)
    r = container.BitReader(w.bytes())
    assert [r.get(b) for _, b in put] == [v for v, _ in put]


def test_sets_tell_the_height_of_the_maps(spark):
    p = kernels.PARAMETERS.changed(map_height=16)
    tables = pipeline.encode(derived.cloud(spark, "/root/testdata/sf0.01"), p)
    units = {(u["gof_id"], u["unit_type"]): container.read_unit(bytes(u["payload"])) for u in tables["units"].collect()}
    rows = tables["images"].filter("map = 'geometry'").groupBy(F.expr("frame_id div 3").alias("gof_id")).agg(F.max("y").alias("y")).collect()
    assert rows and max(r["y"] for r in rows) > 16
    for r in rows:
        assert units[r["gof_id"], "VPS"]["parameters"]["atlases"][0]["height"] == units[r["gof_id"], "AD"]["sequence"]["frame_height"] == r["y"] + 1
    assert sum(len(u.get("tiles", [])) for u in units.values()) == tables["points"].select("frame_id").distinct().count()
    of_maps = {tuple(r) for r in tables["patches"].select("frame_id", "patch_id", "pos_x", "pos_y").collect()}
    assert sum(len(t[1]) for u in units.values() for t in u.get("tiles", [])) == len(of_maps)
    pipeline.release(tables)


def test_frames_without_patches_are_coded(spark):
    p = kernels.PARAMETERS.changed(gof_size=2)
    rows = [(f, i, i % 3 * 20, i // 3 * 20, 5, 9, 9, 9, 2) for f in range(3) for i in range(4)]
    tables = pipeline.encode(spark.createDataFrame(rows, "frame_id int, pt_idx int, x int, y int, z int, r int, g int, b int, ppi int"), p)
    units = {(u["gof_id"], u["unit_type"]): bytes(u["payload"]) for u in pipeline.all_units(tables, p).collect()}
    assert len(units) == 10 and tables["patches"].count() == 0
    assert [[(head["order"], patches) for head, patches in container.read_unit(units[g, "AD"])["tiles"]] for g in (0, 1)] == [[(0, []), (1, [])], [(0, [])]]
    assert [len(units[g, "OVD"]) for g in (0, 1)] == [4 + 2 * 64 * 64, 4 + 64 * 64] and not any(units[0, "OVD"][4:])
    assert tables["images"].filter("map = 'geometry' and layer = 0").count() == 3 * 128
    pipeline.release(tables)
