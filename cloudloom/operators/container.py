"""The coded container: bit writing and reading, parameter sets, patch data, NAL units, unit streams.

Each syntax structure is a grammar (see syntax) that the writer and the reader share, conditions included. Flags for syntax that is not supported (point
local reconstruction, usability information, packing and immersive extensions) can't be set. Where the encoder never sets a flag, the public format decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame

from .syntax import UE, Grammar, Item, Many, Scope, Values, ceil_log2, flag, only, walk

# Fixed values of the format.
UNIT_TYPES = {"VPS": 0, "AD": 1, "OVD": 2, "GVD": 3, "AVD": 4}
NAL_TYPES = {"IDR_N_LP": 23, "ASPS": 36, "AFPS": 37, "EOB": 41}
PATCH_INTRA, PATCH_END = 0, 14
TILE_P, TILE_I, TILE_SKIP = 0, 1, 2
ORDER_BITS = 10

# References from one atlas frame to others.
REFERENCES = Many("reference_lists", flag("list_count"), (
    Item("entries", UE),
    Many("references", flag("entries"), (
        Item("short_term", 1, default=1, absent=1, when=flag("long_term")),
        *only(flag("short_term"), Item("distance", UE), Item("sign", 1, when=flag("distance"))),
        Item("long_term_order", lambda s: s["order_bits_minus4"] + 4, when=lambda s: not s["short_term"]),
    )),
))
SEQUENCE_SET = [
    Item("id", UE), Item("frame_width", UE), Item("frame_height", UE), Item("depth_3d", 5), Item("depth_2d", 5), Item("order_bits_minus4", UE), Item("buffering_minus1", UE), Item("long_term", 1),
    Item("list_count", UE), REFERENCES, Item("eight_orientations", 1), Item("extended_projection", 1), Item("projections_minus1", UE, absent=5, when=flag("extended_projection")),
    Item("quantised_limits", 1), Item("max_delta", 1), Item("precedence", 1), Item("log2_block", 3), Item("size_quantiser", 1), Item("map_count_minus1", 4), Item("deinterleaving", 1),
    Many("deinterleaved", lambda s: s["map_count_minus1"] + 1, (Item("map", 1),), when=flag("deinterleaving")),
    Item("raw_patches", 1), Item("eom_patches", 1), Item("eom_bits_minus1", 4, when=lambda s: s["eom_patches"] and not s["map_count_minus1"]),
    Item("auxiliary", 1, when=lambda s: s["raw_patches"] or s["eom_patches"]), Item("plr", 1), Item("plr_information", None, when=flag("plr")), Item("vui", 1), Item("vui_parameters", None, when=flag("vui")),
    Item("extension", 1), *only(flag("extension"), Item("vpcc_extension", 1), Item("miv_extension", 1), Item("extension_6bits", 6)),
    *only(flag("vpcc_extension"), Item("remove_duplicates", 1), Item("thickness_minus1", UE, when=lambda s: s["deinterleaving"] or s["plr"])),
    Item("miv_parameters", None, when=flag("miv_extension")), Item("extension_data", None, when=flag("extension_6bits")),
]


def _partitions(s: Scope) -> int:
    """Into how many partitions the columns and rows of a frame's grid divide it."""
    if s["single_tile"]:
        return 1
    if s["uniform"]:
        across = lambda size, step: -(-s[size] // (64 * (s[step] + 1)))
        return across("frame_width", "column_width_minus1") * across("frame_height", "row_height_minus1")
    return (s["columns_minus1"] + 1) * (s["rows_minus1"] + 1)


# It refers to the sequence set.
FRAME_SET = [
    Item("id", UE), Item("sequence_set", UE), Item("single_tile", 1, default=1),
    *only(
        lambda s: not s["single_tile"], Item("uniform", 1),
        *only(flag("uniform"), Item("column_width_minus1", UE), Item("row_height_minus1", UE)),
        *only(lambda s: not s["uniform"], Item("columns_minus1", UE), Item("rows_minus1", UE), Many("columns", flag("columns_minus1"), (Item("width_minus1", UE),)), Many("rows", flag("rows_minus1"), (Item("height_minus1", UE),))),
        Item("single_partition", 1),
    ),
    Item("tiles_minus1", UE, absent=lambda s: _partitions(s) - 1, when=lambda s: not s["single_tile"] and not s["single_partition"]),
    Many("tiles", lambda s: s["tiles_minus1"] + 1, (Item("top_left", lambda s: ceil_log2(_partitions(s))), Item("right", UE), Item("bottom", UE)), when=lambda s: not s["single_tile"] and not s["single_partition"]),
    *only(flag("auxiliary"), Item("auxiliary_width_minus1", UE), Many("auxiliary_tiles", lambda s: s["tiles_minus1"] + 1, (Item("height", UE),))),
    Item("signalled_ids", 1), *only(flag("signalled_ids"), Item("id_bits_minus1", UE), Many("tile_ids", lambda s: s["tiles_minus1"] + 1, (Item("tile_id", lambda s: s["id_bits_minus1"] + 1),))),
    Item("output_flag", 1), Item("active_minus1", UE), Item("additional_bits", UE), Item("lod", 1), Item("explicit_offsets", 1),
    Item("extension", 1), *only(flag("extension"), Item("frame_miv_extension", 1), Item("extension_7bits", 7)), Item("frame_miv_parameters", None, when=flag("frame_miv_extension")), Item("extension_data", None, when=flag("extension_7bits")),
]


def _listed(s: Scope) -> list[Values]:
    """The references of a tile: those of its own list, else of the sequence set's."""
    lists = s.maps[-1]["reference_lists"] if s["by_list"] else s["reference_lists"]
    if lists and s["list_index"] >= len(lists):
        raise ValueError("no such list of references")
    return lists[s["list_index"]]["references"] if lists else []


# It refers to the NAL unit's type, the frame set and, as the last, the sequence set.
TILE_HEADER = [
    Item("no_prior_output", 1, when=lambda s: 16 <= s["nal"] <= 29), Item("frame_set", UE), Item("adaptation_set", UE),
    Item("tile", lambda s: s["id_bits_minus1"] + 1 if s["signalled_ids"] else ceil_log2(s["tiles_minus1"] + 1)), Item("type", UE, default=TILE_I), Item("output", 1, when=flag("output_flag")),
    Item("order", lambda s: s["order_bits_minus4"] + 4), Item("by_list", 1, default=1, when=flag("list_count")), replace(REFERENCES, times=lambda s: 1, when=lambda s: not s["by_list"]),
    Item("list_index", lambda s: ceil_log2(s["list_count"]), when=lambda s: s["by_list"] and s["list_count"] > 1),
    Many("additional", lambda s: sum(not x["short_term"] for x in _listed(s)), (Item("present", 1), Item("order_high", flag("additional_bits"), when=flag("present")))),
    *only(
        lambda s: s["type"] != TILE_SKIP, *only(flag("quantised_limits"), Item("min_d_quantiser", 5), Item("delta_quantiser", 5, when=flag("max_delta"))),
        *only(flag("size_quantiser"), Item("size_x_quantiser", 3), Item("size_y_quantiser", 3)), Item("offset_bits_minus1", lambda s: (s["depth_3d"] + 1).bit_length() - 1, when=flag("explicit_offsets")),
        *only(lambda s: s["type"] == TILE_P and len(_listed(s)) > 1, Item("active_override", 1), Item("tile_active_minus1", UE, when=flag("active_override"))),
    ),
]
# It refers to the tile header, the frame set and the sequence set.
PATCH = [
    Item("pos_x", UE), Item("pos_y", UE), Item("size_x_minus1", UE), Item("size_y_minus1", UE), Item("offset_u", lambda s: s["depth_3d"] + 1), Item("offset_v", lambda s: s["depth_3d"] + 1),
    Item("offset_d", lambda s: s["depth_3d"] + 1 - s["min_d_quantiser"]), Item("range_d", lambda s: range_bits(s), when=flag("max_delta")), Item("plane", lambda s: ceil_log2(s["projections_minus1"] + 1)),
    Item("swapped", lambda s: 3 if s["eight_orientations"] else 1), *only(flag("lod"), Item("lod_patch", 1), *only(flag("lod_patch"), Item("lod_x_minus1", UE), Item("lod_y", UE))),
]
NAL_HEADER = [Item("zero", 1), Item("type", 6), Item("layer", 6), Item("temporal_plus1", 3)]
UNIT_HEADER = [Item("type", 5), Item("parameter_set", 4), Item("atlas", 6), Item("zero", 17)]


def range_bits(s: Scope) -> int:
    """Bits of a patch's depth range."""
    return min(s["depth_2d"], s["depth_3d"]) + 1 - s["delta_quantiser"]


def _left(s: Scope) -> int:
    """How many channels, less one, the partitions before this one leave."""
    return s["dimension_minus1"] - sum(x["channels_minus1"] + 1 for x in s["partitions"][:-1])


PARAMETER_SET = [
    Item("tier", 1), Item("codec_group", 7), Item("toolset", 8), Item("reconstruction", 8), Item("reserved_16", 16), Item("max_decodes", 4), Item("reserved_12", 12, default=0xFFF), Item("level", 8),
    Item("sub_profile_count", 6), Item("extended_sub_profile", 1), Many("sub_profiles", flag("sub_profile_count"), (Item("sub_profile", lambda s: 64 if s["extended_sub_profile"] else 32),)), Item("constrained", 1),
    *only(
        flag("constrained"), Item("one_frame_only", 1), Item("no_eom", 1), Item("most_maps_minus1", 4), Item("most_atlases_minus1", 4), Item("no_map_streams", 1), Item("no_plr", 1), Item("most_dimensions_minus1", 6),
        Item("most_partitions_minus1", 6), Item("no_eight_orientations", 1), Item("no_extended_projection", 1), Item("reserved_6", 6), Item("more_constraints", 8), Many("constraints", flag("more_constraints"), (Item("byte", 8),)),
    ),
    Item("id", 4), Item("reserved_8", 8), Item("atlases_minus1", 6),
    Many("atlases", lambda s: s["atlases_minus1"] + 1, (
        Item("atlas", 6), Item("width", UE), Item("height", UE), Item("map_count_minus1", 4), Item("map_streams", 1, when=flag("map_count_minus1")),
        Many("maps", flag("map_count_minus1"), (Item("absolute", 1, default=1), Item("predictor", UE, when=lambda s: not s["absolute"])), when=flag("map_streams")),
        Item("auxiliary", 1), Item("occupancy", 1), Item("geometry", 1), Item("attribute", 1),
        *only(flag("occupancy"), Item("occupancy_codec", 8), Item("occupancy_threshold", 8), Item("occupancy_depth_minus1", 5), Item("occupancy_align", 1)),
        *only(flag("geometry"), Item("geometry_codec", 8), Item("geometry_depth_minus1", 5), Item("geometry_align", 1), Item("depth_3d", 5), Item("auxiliary_geometry_codec", 8, when=flag("auxiliary"))),
        *only(flag("attribute"), Item("attribute_count", 7), Many("attributes", flag("attribute_count"), (
            Item("attribute_type", 4), Item("attribute_codec", 8), Item("auxiliary_codec", 8, when=flag("auxiliary")), Item("persistent_absolute", 1, when=flag("map_count_minus1")), Item("dimension_minus1", 6),
            Item("partitions_minus1", 6, when=flag("dimension_minus1")),
            Many("partitions", flag("partitions_minus1"), (Item("channels_minus1", UE, when=lambda s: len(s["partitions"]) - 1 + _left(s) != s["partitions_minus1"]),)),
            Item("attribute_depth_minus1", 5), Item("attribute_align", 1),
        ))),
    )),
    Item("extension", 1), *only(flag("extension"), Item("packing", 1), Item("miv_extension", 1), Item("extension_6bits", 6)), Item("packing_information", None, when=flag("packing")), Item("miv_parameters", None, when=flag("miv_extension")),
    *only(flag("extension_6bits"), Item("extension_bytes_minus1", UE), Many("extension_data", lambda s: s["extension_bytes_minus1"] + 1, (Item("byte", 8),))),
]


class BitWriter:
    """Bits in coded order; the trace lists (name, code, bits, value)."""

    def __init__(self) -> None:
        self.done, self.pending, self.held = bytearray(), 0, 0
        self.trace: list[tuple[str, str, int, int]] = []

    def put(self, value: int, bits: int, name: str = "") -> None:
        """The low bits of a value."""
        self._put(value, bits)
        self.trace.append((name, f"u({bits})", bits, value))

    def put_ue(self, value: int, name: str = "") -> None:
        bits = 2 * (value + 1).bit_length() - 1
        self._put(value + 1, bits)
        self.trace.append((name, "ue(v)", bits, value))

    def _put(self, value: int, bits: int) -> None:
        self.pending = self.pending << bits | value & (1 << bits) - 1
        self.held += bits
        if self.held > 4096:
            rest = self.held % 8
            self.done += (self.pending >> rest).to_bytes(self.held // 8, "big")
            self.pending, self.held = self.pending & (1 << rest) - 1, rest

    def structure(self, grammar: Grammar, values: Values, *around: Values) -> Values:
        """Writes values by a grammar; those of other structures that it refers to follow. All values, with those inferred."""

        def exchange(item: Item, code: int | str, value: int) -> int:
            if value < 0 or code != UE and value >> code:
                raise ValueError(f"{item.name} does not take {value}")
            self.put_ue(value, item.name) if code == UE else self.put(value, code, item.name)
            return value

        return walk(grammar, exchange, values, *around)

    def trail(self) -> None:
        """A stop bit and zeros up to the next byte."""
        self.put(1, 1)
        self.put(0, -self.held % 8)

    def align(self) -> None:
        """trail(), unless a byte ends here already."""
        if self.held % 8:
            self.trail()

    def bytes(self) -> bytes:
        pad = -self.held % 8
        return bytes(self.done) + (self.pending << pad).to_bytes((self.held + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def get(self, bits: int) -> int:
        if self.at + bits > len(self.bits):
            raise ValueError("the data end within an element")
        self.at += bits
        return int(self.bits[self.at - bits : self.at] or "0", 2)

    def get_ue(self) -> int:
        one = self.bits.find("1", self.at)
        if one < 0:
            raise ValueError("the data end within an element")
        zeros, self.at = one - self.at, one
        return self.get(zeros + 1) - 1

    def structure(self, grammar: Grammar, *around: Values) -> Values:
        return walk(grammar, lambda item, code, _: self.get_ue() if code == UE else self.get(code), None, *around)

    def align(self) -> None:
        self.at += -self.at % 8


def nal(kind: str, payload: bytes) -> bytes:
    w = BitWriter()
    w.structure(NAL_HEADER, {"type": NAL_TYPES[kind], "temporal_plus1": 1})
    return w.bytes() + payload


def tile_layer(header: Values, patches: Iterable[Values], frame_set: Values, sequence_set: Values, kind: str = "IDR_N_LP") -> bytes:
    """One frame's patches as a tile layer: header, patches in order, end mark. Of an order count and a depth range the low bits are coded."""
    w = BitWriter()
    around = frame_set, sequence_set
    header = w.structure(TILE_HEADER, {**header, "order": header.get("order", 0) % (16 << sequence_set["order_bits_minus4"])}, {"nal": NAL_TYPES[kind]}, *around)
    w.align()
    if header["type"] == TILE_I:
        bits = range_bits(Scope(header, *around))
        for p in patches:
            w.put_ue(PATCH_INTRA)
            w.structure(PATCH, {**p, "range_d": p["range_d"] % (1 << bits)} if "range_d" in p else p, header, *around)
        w.put_ue(PATCH_END)
    elif header["type"] != TILE_SKIP:
        raise NotImplementedError("patches of predicted tiles")
    w.trail()
    return w.bytes()


def read_tile_layer(data: bytes, frame_set: Values, sequence_set: Values, kind: str = "IDR_N_LP") -> tuple[Values, list[Values]]:
    r = BitReader(data)
    head, out = r.structure(TILE_HEADER, {"nal": NAL_TYPES[kind]}, frame_set, sequence_set), []
    r.align()
    if head["type"] == TILE_SKIP:
        return head, out
    while (mode := r.get_ue()) != PATCH_END:
        if mode != PATCH_INTRA or head["type"] != TILE_I:
            raise NotImplementedError(f"patch mode {mode} in a tile of type {head['type']}")
        out.append(r.structure(PATCH, head, frame_set, sequence_set))
    return head, out


def sized(nals: list[bytes]) -> bytes:
    """NAL units behind size fields of as many bytes as the largest needs, which the first byte tells."""
    precision = max(1, -(-max(map(len, nals)).bit_length() // 8))
    return bytes([(precision - 1) << 5]) + b"".join(len(n).to_bytes(precision, "big") + n for n in nals)


def sub_units(data: bytes) -> Iterator[bytes]:
    precision, at = (data[0] >> 5) + 1, 1
    while at < len(data):
        size = int.from_bytes(data[at : at + precision], "big")
        yield data[at + precision : at + precision + size]
        at += precision + size


def start_codes(data: bytes) -> list[tuple[int, int]]:
    """(first byte, byte after the last) of each NAL unit of a byte stream with start codes."""
    marks, at = [], data.find(b"\x00\x00\x01")
    while at >= 0:
        marks.append(at)
        at = data.find(b"\x00\x00\x01", at + 3)
    ends = [m - (data[m - 1 : m] == b"\x00") for m in marks[1:]] + [len(data)]
    return [(m + 3, e) for m, e in zip(marks, ends)]


def to_samples(data: bytes, precision: int = 4) -> bytes:
    """A start-code stream as length-prefixed samples."""
    return b"".join((e - s).to_bytes(precision, "big") + data[s:e] for s, e in start_codes(data))


def unit(kind: str, gof_id: int, payload: bytes) -> bytes:
    w = BitWriter()
    w.structure(UNIT_HEADER, {} if kind == "VPS" else {"type": UNIT_TYPES[kind], "parameter_set": gof_id % 16})
    return w.bytes() + payload


def sequence_values(width: int, height: int, depth: int, maps: int, block: int = 2) -> Values:
    """The sequence set that the encoder writes; depth and block as in Parameters."""
    references = [{"entries": 1, "references": [{"distance": 1, "sign": 1}]}]
    return {
        "frame_width": width, "frame_height": height, "depth_3d": depth, "depth_2d": 7, "order_bits_minus4": ORDER_BITS - 4, "list_count": 1, "reference_lists": references, "quantised_limits": 1, "max_delta": 1,
        "log2_block": block.bit_length() - 1, "map_count_minus1": maps - 1, "extension": 1, "vpcc_extension": 1, "remove_duplicates": 1,
    }


def parameter_values(gof_id: int, width: int, height: int, depth: int, maps: int, codecs: dict[str, int] | None = None, group: int = 1) -> Values:
    """The parameter set that the encoder writes; codecs: the codec id of each map, else the profile's codec group."""
    of = lambda name: (codecs or {}).get(name, group)
    attributes = [{"attribute_codec": of("attribute"), "dimension_minus1": 2, "attribute_depth_minus1": 7}]
    atlas = {
        "width": width, "height": height, "map_count_minus1": maps - 1, "occupancy": 1, "geometry": 1, "attribute": 1, "occupancy_codec": of("occupancy"), "occupancy_depth_minus1": 7,
        "geometry_codec": of("geometry"), "geometry_depth_minus1": 7, "depth_3d": depth, "attribute_count": 1, "attributes": attributes,
    }
    return {"codec_group": group, "toolset": 1, "reconstruction": 1, "max_decodes": 15, "level": 30, "id": gof_id % 16, "atlases": [atlas]}


def payload(grammar: Grammar, values: Values, *around: Values) -> tuple[bytes, Values]:
    """A structure up to a whole byte, and all its values."""
    w = BitWriter()
    full = w.structure(grammar, values, *around)
    w.align()
    return w.bytes(), full


def atlas_unit(gof_id: int, frames: list[tuple[int, list[Values]]], sequence: Values, heads: bool = True, quantiser: int = 6) -> bytes:
    """The atlas of some frames under a sequence set; heads: whether parameter sets stand before them."""
    s, sequence_set = payload(SEQUENCE_SET, sequence)
    f, frame_set = payload(FRAME_SET, {"single_tile": 1, "extension": 1}, sequence_set)
    tiles = [nal("IDR_N_LP", tile_layer({"order": order, "min_d_quantiser": quantiser, "delta_quantiser": quantiser}, patches, frame_set, sequence_set)) for order, patches in frames]
    sets = [nal("ASPS", s), nal("AFPS", f)] if heads else []
    return unit("AD", gof_id, sized([*sets, *tiles, nal("EOB", b"")]))


def parameter_unit(gof_id: int, values: Values) -> bytes:
    return unit("VPS", gof_id, payload(PARAMETER_SET, values)[0])


def read_unit(data: bytes, sets: tuple[Values, Values] | None = None) -> Values:
    """What a parameter or atlas unit says: header, and parameters or sequence, frame and tiles (header, patches).

    sets: the frame and sequence set that hold for an atlas unit without its own.
    """
    r = BitReader(data[:4])
    out: Values = {"header": r.structure(UNIT_HEADER)}
    if out["header"]["type"] == UNIT_TYPES["VPS"]:
        return out | {"parameters": BitReader(data[4:]).structure(PARAMETER_SET)}
    if out["header"]["type"] != UNIT_TYPES["AD"]:
        return out
    out["frame"], out["sequence"] = sets or ({}, {})
    out["tiles"], kinds = [], {v: k for k, v in NAL_TYPES.items()}
    for sub in sub_units(data[4:]):
        kind, body = kinds.get(BitReader(sub[:2]).structure(NAL_HEADER)["type"]), sub[2:]
        if kind == "ASPS":
            out["sequence"] = BitReader(body).structure(SEQUENCE_SET)
        elif kind == "AFPS":
            out["frame"] = BitReader(body).structure(FRAME_SET, out["sequence"])
        elif kind != "EOB" and kind:
            out["tiles"].append(read_tile_layer(body, out["frame"], out["sequence"], kind))
    return out


FILE_PRECISION = 5


def file_bytes(units: Iterable[bytes]) -> bytes:
    """A whole file: one byte that tells the size fields' width, then every unit behind its size."""
    return bytes([(FILE_PRECISION - 1) << 5]) + b"".join(len(u).to_bytes(FILE_PRECISION, "big") + u for u in units)


def _rows(patches: pd.DataFrame) -> int:
    """Rows of blocks that patches take up; w and h change places where a patch is swapped."""
    return 0 if patches.empty else int((patches["pos_y"] + patches["size_y_minus1"].where(patches["swapped"] == 0, patches["size_x_minus1"])).max()) + 1


def atlas_units(patches: DataFrame, gof_size: int, width: int, height: int, depth: int, maps: int = 2, low_delay: bool = False, block: int = 2, step: int = 64, codecs: dict[str, int] | None = None, group: int = 1) -> DataFrame:
    """(gof_id, unit_seq, unit_type, payload) of patches(frame_id, patch_id and fields of PATCH): parameter and atlas units.

    A frame without patches is one row whose other columns are null. A task for each group of frames; the coded maps of a video codec follow as OVD, GVD and AVD units. With low_delay each
    frame has an atlas unit of its own, four places apart, parameter sets only in the first one of a group. height is the least
    that the sets tell: they tell that of the group's maps. step: what depths are divided by, a power of two; codecs and group as in parameter_values.
    """
    names, quantiser = [x.name for x in PATCH if x.name in patches.columns], step.bit_length() - 1

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        gof, tall = int(key[0]), max(height, -(-_rows(own.dropna(subset="patch_id")) // 8) * 8 * block)
        sequence = sequence_values(width, tall, depth, maps, block)
        frames = [(int(f) % gof_size, of.dropna(subset="patch_id").sort_values("patch_id")[names].astype(int).to_dict("records")) for f, of in sorted(own.groupby("frame_id"))]
        if low_delay:
            atlas = [(1 + 4 * place, "AD", atlas_unit(gof, [(place, patches)], sequence, place == frames[0][0], quantiser)) for place, patches in frames]
        else:
            atlas = [(1, "AD", atlas_unit(gof, frames, sequence, True, quantiser))]
        units = [(0, "VPS", parameter_unit(gof, parameter_values(gof, width, tall, depth, maps, codecs, group))), *atlas]
        return pd.DataFrame([(gof, *u) for u in units], columns=["gof_id", "unit_seq", "unit_type", "payload"])

    keyed = patches.selectExpr("*", f"frame_id div {gof_size} as gof_id")
    return keyed.groupBy("gof_id").applyInPandas(work, "gof_id long, unit_seq int, unit_type string, payload binary")


def set_values(units: DataFrame) -> DataFrame:
    """(gof_id, structure, name, value) of the parameter, sequence and frame sets of units, read back; the parts of lists by name[place]."""

    def flat(values: Values, before: str = "") -> Iterator[tuple[str, int]]:
        for name, v in values.items():
            if isinstance(v, list):
                for i, part in enumerate(v):
                    yield from flat(part, f"{before}{name}[{i}].")
            else:
                yield before + name, v

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(gof, structure, *pair) for gof, data in zip(batch["gof_id"], batch["payload"]) for structure, values in read_unit(bytes(data)).items() if structure in ("parameters", "sequence", "frame") for pair in flat(values)]
            yield pd.DataFrame(rows, columns=["gof_id", "structure", "name", "value"])

    return units.filter("unit_type in ('VPS', 'AD')").select("gof_id", "payload").mapInPandas(work, "gof_id long, structure string, name string, value long")
