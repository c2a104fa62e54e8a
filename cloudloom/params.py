"""Parameters of an encoding run: registry, presets, rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

# What the presets set, by (voxel size, preset).
_COLUMNS = [(9, "fast"), (9, "slow"), (10, "fast"), (10, "slow"), (11, "fast"), (11, "slow")]
_VALUES = {
    "gof_size": (16, 8, 16, 16, 16, 16),
    "voxel_depth": (8, 9, 9, 10, 9, 10),
    "normal_neighbours": (6, 12, 6, 12, 8, 9),
    "diagonal_steps": (4, 8, 4, 8, 8, 13),
    "refine_depth": (7, 8, 8, 9, 6, 10),
    "refine_reach": (2, 9, 2, 9, 5, 9),
    "refine_weight": (3.5, 3.0, 3.5, 3.0, 3.5, 3.5),
    "refine_sweeps": (3, 15, 3, 15, 9, 19),
    "sliced_reach": (2, 4, 2, 6, 5, 9),
    "sliced_weight": (3.5, 5.0, 3.5, 5.0, 3.5, 3.5),
    "sliced_sweeps": (3, 10, 3, 10, 9, 19),
    "least_points": (16, 5, 16, 5, 16, 16),
    "map_width": (608, 608, 1024, 1024, 2048, 2048),
    "map_height": (608, 608, 1024, 1024, 2048, 2048),
    "threshold2": (1, 1, 1, 1, 1, 1),
    "threshold4": (2, 2, 1, 1, 1, 1),
}
PRESETS = {key: {name: values[i] for name, values in _VALUES.items()} for i, key in enumerate(_COLUMNS)}


# Published names of parameters, their kinds and allowed values, and the field that takes each here. Those without a field are kept
# in `others`: a codec gets what is of its map, the rest is accepted and has no effect on Spark jobs.
NAMES = """
geoBitDepthInput uint - input_depth
presetName text fast,slow preset
intermediateFilesDir text - -
statisticsDir text - -
sizeGOF uint 8,16 gof_size
nbThreadPCPart uint - -
maxConcurrentFrames uint - in_flight
doubleLayer bool - double_layer
logLevel text - -
errorsAreFatal bool - -
exportIntermediateFiles bool - -
exportStatistics bool - -
intermediateFilesDirTimeStamp bool - -
timerLog bool - -
lowDelayBitstream bool - low_delay
geoBitDepthVoxelized uint - voxel_depth
activateSlicing bool - sliced
kdTreeMaxLeafSize uint - -
normalComputationKnnCount uint - normal_neighbours
normalComputationMaxDiagonalStep uint - diagonal_steps
normalOrientationKnnCount uint - orientation_neighbours
geoBitDepthRefineSegmentation uint - refine_depth
refineSegmentationMaxNNVoxelDistanceLUT uint - refine_reach
refineSegmentationLambda float - refine_weight
refineSegmentationIterationCount uint - refine_sweeps
refineSegmentationIDEVDist uint - indirect_reach
slicingRefineSegmentationMaxNNVoxelDistanceLUT uint - sliced_reach
slicingRefineSegmentationLambda float - sliced_weight
slicingRefineSegmentationIterationCount uint - sliced_sweeps
maxAllowedDist2RawPointsDetection uint - covered_distance
minPointCountPerCC uint - least_points
patchSegmentationMaxPropagationDistance uint - propagation
enablePatchSplitting bool - -
minLevel uint - plane_step
log2QuantizerSizeX uint - -
log2QuantizerSizeY uint - -
quantizerSizeX uint - -
quantizerSizeY uint - -
surfaceThickness uint - thickness
mapWidth uint - map_width
minimumMapHeight uint - map_height
spacePatchPacking uint - space
interPatchPacking bool - mode
gpaTresholdIoU float - iou
mapGenerationBackgroundValueAttribute uint - background_attribute
mapGenerationBackgroundValueGeometry uint - background_geometry
attributeBgFill text none,patchExtension,bbpe,pushPull fill
blockSizeBBPE uint 0,1,2,4,8,16,32,64,128 fill_block
useTmc2YuvDownscaling bool - filtered_chroma
mapGenerationFillEmptyBlock bool - -
dynamicMapHeight bool - growing_height
sizeGOP2DEncoding uint 8,16 -
intraFramePeriod uint - -
encoderInfoSEI bool - -
occupancyEncoderName text - -
occupancyEncodingIsLossless bool - -
occupancyEncodingMode text AI,RA -
occupancyEncodingFormat text YUV420 -
occupancyEncodingNbThread uint - -
occupancyMapDSResolution uint 2,4 block
occupancyEncodingPreset text ultrafast,superfast,veryfast,faster,fast,medium,slow,slower,veryslow -
omRefinementTreshold2 uint 1,2,3,4 threshold2
omRefinementTreshold4 uint 1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16 threshold4
geometryEncoderName text - -
geometryEncodingIsLossless bool - -
geometryEncodingMode text AI,RA -
geometryEncodingFormat text YUV420 -
geometryEncodingNbThread uint - -
geometryEncodingQp uint - geometry_qp
geometryEncodingPreset text ultrafast,superfast,veryfast,faster,fast,medium,slow,slower,veryslow -
attributeEncoderName text - -
attributeEncodingIsLossless bool - -
attributeEncodingMode text AI,RA -
attributeEncodingFormat text YUV420 -
attributeEncodingNbThread uint - -
attributeEncodingQp uint - attribute_qp
attributeEncodingPreset text ultrafast,superfast,veryfast,faster,fast,medium,slow,slower,veryslow -
displayBitstreamGenerationFps bool - -
"""


@dataclass(frozen=True)
class Named:
    """A published parameter: its kind, allowed values (empty: any of the kind), field here (None: kept in others)."""

    kind: str
    allowed: tuple[str, ...]
    field: str | None

    def value(self, name: str, text: str) -> object:
        """text as this kind, strictly; an error tells what is allowed."""
        if not text:
            raise ValueError(f"{name}: an empty value")
        if self.allowed and text not in self.allowed:
            raise ValueError(f"{name}: {text!r} is none of {', '.join(self.allowed)}")
        if self.kind == "bool":
            if text.lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"{name}: {text!r} is no boolean")
            return text.lower() in ("true", "1")
        if self.kind == "uint":
            if not re.fullmatch(r"[0-9]+", text):
                raise ValueError(f"{name}: {text!r} is no number from 0 on")
            return int(text)
        if self.kind == "float":
            if not re.fullmatch(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?", text):
                raise ValueError(f"{name}: {text!r} is no number")
            return float(text)
        return text


PUBLISHED = {name: Named(kind, tuple(allowed.split(",")) if allowed != "-" else (), None if field == "-" else field) for name, kind, allowed, field in (line.split() for line in NAMES.strip().splitlines())}


@dataclass(frozen=True)
class Parameters:
    """One run's parameters; with() makes changed copies."""

    input_depth: int = 10
    preset: str = "fast"
    mode: str = "RA"
    gof_size: int = 16
    voxel_depth: int = 9
    normal_neighbours: int = 6
    diagonal_steps: int = 4
    carried_turns: bool = False
    orientation_neighbours: int = 4
    tile: int = 0
    refine_depth: int = 8
    refine_reach: int = 2
    refine_weight: float = 3.5
    refine_sweeps: int = 3
    sliced: bool = False
    sliced_reach: int = 2
    sliced_weight: float = 3.5
    sliced_sweeps: int = 3
    indirect_reach: int = 3
    covered_distance: int = 5
    propagation: int = 3
    plane_step: int = 64
    thickness: int = 4
    peak_distance: int = 32
    least_points: int = 16
    map_width: int = 1024
    map_height: int = 1024
    growing_height: bool = True
    block: int = 2
    threshold2: int = 1
    threshold4: int = 1
    space: int = 1
    iou: float = 0.3
    background_geometry: int = 128
    background_attribute: int = 128
    fill: str = "patchExtension"
    fill_block: int = 8
    filtered_chroma: bool = False
    low_delay: bool = False
    double_layer: bool = True
    geometry_qp: int = 32
    attribute_qp: int = 42
    in_flight: int = 64
    others: tuple[tuple[str, object], ...] = ()

    def codec_options(self, kind: str) -> dict[str, object]:
        """What a codec of a map's images (occupancy, geometry, attribute) is told: what was set for that map, its quality and the group's size."""
        own = {name.removeprefix(kind).removeprefix("Encoding"): value for name, value in self.others if name.startswith(kind)}
        shared = {name: value for name, value in self.others if name in ("sizeGOP2DEncoding", "intraFramePeriod", "encoderInfoSEI")}
        quality = {"geometry": self.geometry_qp, "attribute": self.attribute_qp}.get(kind)
        return {"Mode": self.mode, "sizeGOF": self.gof_size, **shared, **own, **({} if quality is None else {"Qp": quality})}

    def changed(self, **values: object) -> "Parameters":
        known = {f.name for f in fields(self)}
        for name in values:
            if name not in known:
                raise ValueError(f"no parameter {name}; did you mean {nearest(name, sorted(known))}?")
        return replace(self, **values)


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def nearest(name: str, names: list[str]) -> str:
    return min(names, key=lambda n: (distance(name, n), n))


def preset(depth: int, name: str) -> dict[str, object]:
    """What a preset sets at a bit depth; below 9 and above 11 it is derived from the nearest."""
    base = dict(PRESETS[min(max(depth, 9), 11), name])
    if depth < 9 or depth > 11:
        base["voxel_depth"], base["refine_depth"] = (depth - 1, depth - 2) if name == "fast" else (depth, depth - 1)
    if depth > 11:
        base["map_width"] = base["map_height"] = (1 + depth - 11) * 2048
    return base


def parse_rate(text: str) -> dict[str, int]:
    found = re.fullmatch(r"(\d+)-(\d+)-(\d+)", text)
    if not found:
        raise ValueError(f"a rate looks like 16-22-2, not {text!r}")
    return dict(zip(("geometry_qp", "attribute_qp", "block"), map(int, found.groups())))


def parse_pairs(text: str) -> dict[str, str]:
    """`k=v,k=v`; a name given twice is an error."""
    out: dict[str, str] = {}
    for name, value in re.findall(r"(\w+)=([^,]*)", text):
        if name in out:
            raise ValueError(f"{name} is given twice")
        out[name] = value
    return out


def typed(name: str, value: str) -> dict[str, object]:
    """{field: value} of a parameter given by its published name or its field, as its type, strictly."""
    kinds = {f.name: type(f.default) for f in fields(Parameters) if f.name != "others"}
    if name in PUBLISHED:
        known, found = PUBLISHED[name], PUBLISHED[name].value(name, value)
        if known.field == "mode":
            found = "RA" if found else "AI"
        return {known.field: found} if known.field else {name: found}
    if name not in kinds:
        raise ValueError(f"no parameter {name}; did you mean {nearest(name, sorted([*kinds, *PUBLISHED]))}?")
    kind = {bool: "bool", int: "uint", float: "float", str: "text"}[kinds[name]]
    return {name: Named(kind, (), name).value(name, value)}


def resolve(depth: int = 10, name: str = "fast", mode: str = "RA", rate: str | None = None, overrides: str = "") -> Parameters:
    """Preset, then rate, then the user's own values (by published name or field, each once); checked."""
    given = parse_pairs(overrides)
    name, mode, rate = given.pop("presetName", name), given.pop("mode", mode), given.pop("rate", rate)
    depth = int(given.pop("geoBitDepthInput", depth))
    if name not in ("fast", "slow") or mode not in ("AI", "RA"):
        raise ValueError(f"no preset {name} or mode {mode}")
    values: dict[str, object] = {"input_depth": depth, "preset": name, "mode": mode, **preset(depth, name)}
    if rate:
        values |= parse_rate(rate)
    own, others = {}, {}
    for key, text in given.items():
        for field, value in typed(key, text).items():
            if field in own or field in others:
                raise ValueError(f"{key}: {field} is given twice")
            (others if field in PUBLISHED else own)[field] = value
    values |= own
    if values.get("in_flight", 64) == 0:
        values["in_flight"] = 4 * int(values.get("gof_size", 16))
    if "lowDelayBitstream" in given and values["low_delay"] and not others.get("encoderInfoSEI"):
        raise ValueError("lowDelayBitstream needs encoderInfoSEI")
    return checked(Parameters().changed(**values, others=tuple(sorted(others.items()))))


def checked(p: Parameters) -> Parameters:
    """p, if it keeps the rules."""
    gop, period = dict(p.others).get("sizeGOP2DEncoding", 16 if p.gof_size > 8 else 8), dict(p.others).get("intraFramePeriod", 64)
    rules = {
        "gof_size is 1 to 16": 1 <= p.gof_size <= 16,
        "gof_size is at most in_flight": p.gof_size <= p.in_flight,
        "fill_block is 1 to 128 and divides the map": 1 <= p.fill_block <= 128 and p.map_width % p.fill_block == p.map_height % p.fill_block == 0,
        "backgrounds are bytes": all(0 <= b <= 255 for b in (p.background_geometry, p.background_attribute)),
        "iou is 0 to 1": 0 <= p.iou <= 1,
        "block is 2 or 4": p.block in (2, 4),
        "the map's sides are multiples of 8 blocks": p.map_width % (8 * p.block) == p.map_height % (8 * p.block) == 0,
        "reaches are 1 to 9": all(1 <= r <= 9 for r in (p.refine_reach, p.sliced_reach)),
        "thresholds lie within their blocks": 1 <= p.threshold2 <= 4 and 1 <= p.threshold4 <= 16,
        "diagonal_steps is 1 or more": p.diagonal_steps >= 1,
        "tile is 0 (a frame is a task) or 8 and more": p.tile == 0 or p.tile >= 8,
        "depths fit": p.refine_depth <= p.voxel_depth <= p.input_depth,
        "intraFramePeriod is a multiple of sizeGOP2DEncoding": period % gop == 0,
        "occupancy maps are coded without loss": dict(p.others).get("occupancyEncodingIsLossless", True),
        "files and statistics have a folder": all(not dict(p.others).get(what) or dict(p.others).get(where) for what, where in (("exportIntermediateFiles", "intermediateFilesDir"), ("exportStatistics", "statisticsDir"))),
        "distances have steps": p.covered_distance <= 9 and p.propagation <= 9,
        "fill is known": p.fill in ("patchExtension", "bbpe", "pushPull", "none"),
    }
    broken = [rule for rule, kept in rules.items() if not kept]
    if broken:
        raise ValueError("; ".join(broken))
    return p
