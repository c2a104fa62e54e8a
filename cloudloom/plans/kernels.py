"""Queries for the operators that work on a whole frame, slice or group of frames at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import SLICE_PLANES
from ..operators import atlas, color, container, fill, normals, refine, rounds, tiles, weave
from ..operators.neighbors import nearest
from ..params import Parameters
from ..operators.patches import projected
from ..operators.slices import levels
from . import derived, pipeline
from .queries import AXES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Parameters that suit the derived clouds' six bits.
PARAMETERS = Parameters(input_depth=6, voxel_depth=6, refine_depth=5, gof_size=3, map_width=128, map_height=128, block=2, mode="RA")


def query(thick: bool = False, sql: str | None = None):
    """Registers f(pc) under its name; sql may name pc and the CTEs of queries.AXES, which stand before it."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(derived.cloud(spark, sf_dir, thick))
        if sql is not None:
            ORACLES[f.__name__] = f"with {derived.oracle(thick)},\n{AXES[5:]}\n{sql}"
        return f

    return add


@query()
def oriented_normals(pc: DataFrame) -> DataFrame:
    return normals.with_normals(pc, 12, 4)


@query()
def refine_exact(pc: DataFrame) -> DataFrame:
    return pipeline.segmented(pc, PARAMETERS).select("frame_id", "pt_idx", "ppi")


@query()
def refine_sliced(pc: DataFrame) -> DataFrame:
    return refine.refined(pc.withColumn("plane", F.col("ppi")), 1, use_normals=False)


@query()
def slicing_ppi(pc: DataFrame) -> DataFrame:
    return weave.sliced_planes(pc)


@query(thick=True)
def patch_loop(pc: DataFrame) -> DataFrame:
    return rounds.patch_pixels(pc, 16)


def _patches(pc: DataFrame) -> DataFrame:
    return pipeline.boxes(rounds.patch_pixels(pc, 5), PARAMETERS)


@query()
def intra_packing(pc: DataFrame) -> DataFrame:
    return atlas.pack_intra(_patches(pc), 128, 128, 2)


@query()
def inter_packing(pc: DataFrame) -> DataFrame:
    return atlas.pack_inter(_patches(pc), 3, 128, 128, 2)


def _images(pc: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Each plane of each frame as a 64 x 64 depth image with its occupancy, filled by work: (frame_id, ppi, y, row bytes)."""

    def run(plane: pd.DataFrame) -> pd.DataFrame:
        image, occupancy = np.full((64, 64), fill.BACKGROUND, np.uint8), np.zeros((64, 64), bool)
        at = plane["v"].to_numpy(), plane["u"].to_numpy()
        image[at], occupancy[at] = 0, True
        np.maximum.at(image, at, plane["d"].to_numpy(np.uint8))
        done = work(image, occupancy)
        return pd.DataFrame({"frame_id": plane["frame_id"].iloc[0], "ppi": plane["ppi"].iloc[0], "y": range(64), "line": [r.tobytes() for r in done]})

    return projected(pc).select("frame_id", "ppi", "u", "v", "d").groupBy("frame_id", "ppi").applyInPandas(run, "frame_id int, ppi int, y int, line binary")


def _blocks(occupancy: np.ndarray, block: int) -> np.ndarray:
    h, w = occupancy.shape
    return occupancy.reshape(h // block, block, w // block, block).any((1, 3))


@query()
def dilate_fill(pc: DataFrame) -> DataFrame:
    return _images(pc, lambda i, o: fill.copy_left(fill.dilate_blocks(i, _blocks(o, 4), 4), _blocks(o, 4), 4))


@query()
def bbpe_fill(pc: DataFrame) -> DataFrame:
    return _images(pc, lambda i, o: fill.grow_blocks(i, o, 8))


@query()
def push_pull_fill(pc: DataFrame) -> DataFrame:
    return _images(pc, fill.pull_push)


@query()
def v3c_units(pc: DataFrame) -> DataFrame:
    return pipeline.encode(pc, PARAMETERS)["units"]


SETS = """, groups as (select distinct (frame_id // 3)::bigint as gof_id from pc), told(structure, name, value) as (values
 ('parameters', 'codec_group', 1), ('parameters', 'toolset', 1), ('parameters', 'reconstruction', 1), ('parameters', 'max_decodes', 15), ('parameters', 'reserved_12', 4095), ('parameters', 'level', 30),
 ('parameters', 'atlases[0].width', 128), ('parameters', 'atlases[0].map_count_minus1', 1), ('parameters', 'atlases[0].occupancy', 1), ('parameters', 'atlases[0].geometry', 1), ('parameters', 'atlases[0].attribute', 1),
 ('parameters', 'atlases[0].occupancy_codec', 1), ('parameters', 'atlases[0].occupancy_depth_minus1', 7), ('parameters', 'atlases[0].geometry_codec', 1), ('parameters', 'atlases[0].geometry_depth_minus1', 7), ('parameters', 'atlases[0].depth_3d', 6),
 ('parameters', 'atlases[0].attribute_count', 1), ('parameters', 'atlases[0].attributes[0].attribute_codec', 1), ('parameters', 'atlases[0].attributes[0].dimension_minus1', 2), ('parameters', 'atlases[0].attributes[0].attribute_depth_minus1', 7),
 ('sequence', 'frame_width', 128), ('sequence', 'depth_3d', 6), ('sequence', 'depth_2d', 7), ('sequence', 'order_bits_minus4', 6), ('sequence', 'list_count', 1), ('sequence', 'reference_lists[0].entries', 1),
 ('sequence', 'reference_lists[0].references[0].short_term', 1), ('sequence', 'reference_lists[0].references[0].distance', 1), ('sequence', 'reference_lists[0].references[0].sign', 1), ('sequence', 'projections_minus1', 5),
 ('sequence', 'quantised_limits', 1), ('sequence', 'max_delta', 1), ('sequence', 'log2_block', 1), ('sequence', 'map_count_minus1', 1), ('sequence', 'extension', 1), ('sequence', 'vpcc_extension', 1), ('sequence', 'remove_duplicates', 1),
 ('frame', 'single_tile', 1), ('frame', 'extension', 1))
select gof_id, structure, name, value::bigint as value from groups, told
union all select gof_id, 'parameters', 'id', gof_id % 16 from groups where gof_id % 16 <> 0"""


@query(sql=SETS)
def parameter_sets(pc: DataFrame) -> DataFrame:
    """What is not zero in every group's parameter, sequence and frame set, read back from its units; but for heights, which the packing decides."""
    return container.set_values(pipeline.encode(pc, PARAMETERS)["units"]).filter("value <> 0 and name not in ('frame_height', 'atlases[0].height')")


@query()
def atlas_maps(pc: DataFrame) -> DataFrame:
    return pipeline.encode(pc, PARAMETERS)["maps"]


@query()
def yuv_fir(pc: DataFrame) -> DataFrame:
    """The colours of each plane of each frame, as luma and filtered chroma rows."""

    def run(seen: pd.DataFrame) -> pd.DataFrame:
        rgb, seen = np.full((64, 64, 3), fill.BACKGROUND, np.uint8), seen.sort_values("pt_idx")
        rgb[seen["v"], seen["u"]] = seen[["r", "g", "b"]]
        planes = zip("yuv", color.filtered_yuv(rgb))
        return pd.DataFrame([(seen["frame_id"].iloc[0], seen["ppi"].iloc[0], name, i, line.tobytes()) for name, p in planes for i, line in enumerate(p)], columns=["frame_id", "ppi", "plane", "y", "line"])

    return projected(pc).groupBy("frame_id", "ppi").applyInPandas(run, "frame_id int, ppi int, plane string, y int, line binary")


_TAPS = lambda name, taps: f"{name}(j, w) as (select unnest(range({len(taps)})), unnest([{', '.join(map(str, taps))}]::double[]))"
#: Filters in 32-bit taps of 512 parts, each step's result in 32 bits; what is outside repeats the border.
SAMPLES = f""", seen as (select frame_id, ppi, u, v, arg_max(r, pt_idx) as r, arg_max(g, pt_idx) as g, arg_max(b, pt_idx) as b from pix group by all),
image as (select f.frame_id, f.ppi, y, x, coalesce(r, 128) / 255 as r, coalesce(g, 128) / 255 as g, coalesce(b, 128) / 255 as b
 from (select distinct frame_id, ppi from pc) f cross join range(64) h(y) cross join range(64) w(x) left join seen s on s.frame_id = f.frame_id and s.ppi = f.ppi and s.u = x and s.v = y),
yuv as (select frame_id, ppi, y, x, greatest(0, least(1, r * 0.2126::double + g * 0.7152::double + b * 0.0722::double))::float as luma,
 greatest(-0.5, least(0.5, r * -0.114572::double + g * -0.385428::double + b * 0.5::double))::float as cb, greatest(-0.5, least(0.5, r * 0.5::double + g * -0.454153::double + b * -0.045847::double))::float as cr from image),
{_TAPS('across', color.HORIZONTAL)}, {_TAPS('down', color.VERTICAL)},
narrow as (select frame_id, ppi, y, k as x, (sum((w * 512)::float::double * cb) / 512)::float as cb, (sum((w * 512)::float::double * cr) / 512)::float as cr from range(32) h(k) cross join across join yuv on yuv.x = greatest(0, least(63, 2 * k + j - 7)) group by all),
small as (select frame_id, ppi, k as y, x, (sum((w * 512)::float::double * cb) / 512)::float as cb, (sum((w * 512)::float::double * cr) / 512)::float as cr from range(32) h(k) cross join down join narrow on narrow.y = greatest(0, least(63, 2 * k + j - 7)) group by k, frame_id, ppi, x)
select frame_id, ppi, 'y' as plane, y::int as y, x::int as x, floor(255 * luma::double + 0.5)::int as sample from yuv
union all select frame_id, ppi, 'u', y::int, x::int, greatest(0, least(255, floor(255 * cb::double + 128.5)))::int from small
union all select frame_id, ppi, 'v', y::int, x::int, greatest(0, least(255, floor(255 * cr::double + 128.5)))::int from small"""


@query(sql=SAMPLES)
def yuv_samples(pc: DataFrame) -> DataFrame:
    """Every sample of the luma and filtered chroma rows."""
    samples = F.expr("transform(sequence(1, octet_length(line)), i -> cast(conv(hex(substring(line, i, 1)), 16, 10) as int))")
    return yuv_fir(pc).select("frame_id", "ppi", "plane", "y", F.posexplode(samples).alias("x", "sample"))


# What holds for the results above whatever the kernels do; SQL can say it without them.

COARSE = PARAMETERS.changed(voxel_depth=5, refine_depth=4, refine_sweeps=1)


@query(sql="select frame_id, count(*) as points, count(distinct (x >> 1, y >> 1, z >> 1)) as voxels, 0 as split_voxels, 0 as odd_planes from pc group by frame_id")
def segmented_voxels(pc: DataFrame) -> DataFrame:
    """Points planned by voxels: none is lost, and the points of a voxel share a plane."""
    rows = pipeline.segmented(pc, COARSE)
    voxels = rows.groupBy("frame_id", *(F.shiftright(c, 1).alias(f"v{c}") for c in "xyz")).agg(F.count("*").alias("n"), F.count_distinct("ppi").alias("planes"), F.count_if(~F.col("ppi").between(0, 5)).alias("odd"))
    return voxels.groupBy("frame_id").agg(F.sum("n").alias("points"), F.count("*").alias("voxels"), F.count_if(F.expr("planes > 1")).cast("int").alias("split_voxels"), F.sum("odd").cast("int").alias("odd_planes"))


@query(sql="select frame_id, count(*) as points, 0 as long, 0 as away from pc group by frame_id")
def normals_rules(pc: DataFrame) -> DataFrame:
    """Normals have length one and face the plane that is named for them."""
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    axes = F.array(*n, *(-c for c in n))
    rows = normals.with_normals(pc, 12, 4)
    return rows.groupBy("frame_id").agg(F.count("*").alias("points"), F.count_if(F.abs(sum(c * c for c in n) - 1) > 1e-9).cast("int").alias("long"), F.count_if(F.element_at(axes, F.col("plane") + 1) < F.array_max(axes) - 1e-9).cast("int").alias("away"))


@query(sql="select frame_id, count(*) as points, 0 as away from pc group by frame_id")
def bounded_normals(pc: DataFrame) -> DataFrame:
    """The bounded diagonaliser finds the exact normals where it has looks enough and the two least spreads are apart."""
    keys = ["frame_id", "pt_idx"]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx", ignore_index=True)
        xyz = frame[["x", "y", "z"]].to_numpy(np.int64)
        found = nearest(xyz, 12)
        near = xyz[np.where(found < 0, found[:, :1], found)].astype(float)
        near -= near.mean(1, keepdims=True)
        spread = np.linalg.eigvalsh(np.einsum("nki,nkj->nij", near, near) / 11)
        same = np.abs((normals.principal_normals(xyz, found) * normals.principal_normals(xyz, found, 40, carried=False)).sum(1))
        return frame[keys].assign(away=(same < 1 - 1e-6) & (spread[:, 1] - spread[:, 0] > 1e-3))

    rows = pc.select(*keys, "x", "y", "z").groupBy("frame_id").applyInPandas(work, "frame_id int, pt_idx int, away boolean")
    return rows.groupBy("frame_id").agg(F.count("*").alias("points"), F.count_if("away").cast("int").alias("away"))


@query(sql="select frame_id, count(*) as points, 0 as unequal, 0 as against from pc group by frame_id")
def tiled_normals(pc: DataFrame) -> DataFrame:
    """Normals found by tiles of 16 cells are those of whole frames, and each agrees with the neighbour whose normal is most alike (that edge is in every maximum spanning forest)."""
    n = ("nx", "ny", "nz")
    whole = normals.with_normals(pc, 12, 4).select("frame_id", "pt_idx", *(F.col(c).alias(f"w{c}") for c in n))
    rows = tiles.unoriented(pc, 12, 4, tile=16, halo=4)
    turned = tiles.turned(rows).select("frame_id", "pt_idx", *n)
    ends = rows.select("frame_id", F.col("pt_idx").alias("u"), F.explode(F.slice("nb", 2, 4)).alias("v")).filter("u <> v")
    ends = ends.unionByName(ends.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v")))
    mine, other = (turned.select("frame_id", F.col("pt_idx").alias(e), *(F.col(c).alias(f"{e}{c}") for c in n)) for e in "uv")
    dot = sum(F.col(f"u{c}") * F.col(f"v{c}") for c in n)
    edges = ends.join(mine, ["frame_id", "u"]).join(other, ["frame_id", "v"]).select("frame_id", "u", dot.alias("dot"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    best = edges.groupBy("frame_id", F.col("u").alias("pt_idx")).agg(F.min_by("dot", F.struct(-F.abs("dot"), "a", "b")).alias("dot"))
    along = sum(F.col(c) * F.col(f"w{c}") for c in n)
    both = whole.join(turned, ["frame_id", "pt_idx"], "left").join(best, ["frame_id", "pt_idx"], "left")
    return both.groupBy("frame_id").agg(F.count("*").alias("points"), F.count_if(F.coalesce(F.abs(along), F.lit(0)) < 1 - 1e-9).cast("int").alias("unequal"), F.count_if(F.col("dot") < 0).cast("int").alias("against"))


@query(sql="select frame_id, axis, count(*) as points, 0 as twice, 0 as idle, 0 as far, 0 as childless, 0 as foreign from pc, (values (0), (1), (2)) a(axis) group by all")
def woven_rules(pc: DataFrame) -> DataFrame:
    """Every point of a slice has a plane or a parent, not both; parents have planes and lie in reach in the same slice; planes are those that the axis can tell."""
    rows, places = weave.woven(pc), levels(pc).select("frame_id", "axis", "pt_idx", "level", "a", "b")
    own = rows.join(places, ["frame_id", "axis", "pt_idx"])
    above = own.select("frame_id", "axis", *(F.col(c).alias(f"up_{c}") for c in ("pt_idx", "plane", "level", "a", "b")))
    both = own.join(above, (own["frame_id"] == above["frame_id"]) & (own["axis"] == above["axis"]) & (own["parent"] == above["up_pt_idx"]), "left").select(own["*"], "up_pt_idx", "up_plane", "up_level", "up_a", "up_b")
    child, reach = F.col("parent").isNotNull(), F.pow(F.col("a") - F.col("up_a"), 2) + F.pow(F.col("b") - F.col("up_b"), 2)
    told = F.element_at(F.array(*(F.array(*map(F.lit, SLICE_PLANES[i])) for i in range(3))), F.col("axis") + 1)
    count = lambda c, name: F.count_if(c).cast("int").alias(name)
    return both.groupBy("frame_id", "axis").agg(
        F.count("*").alias("points"),
        count(child & F.col("plane").isNotNull(), "twice"),
        count(~child & F.col("plane").isNull(), "idle"),
        count(child & ((F.col("up_level") != F.col("level")) | (reach > 10)), "far"),
        count(child & F.col("up_plane").isNull(), "childless"),
        count(F.col("plane").isNotNull() & (F.col("plane") != 0) & ~F.array_contains(told, F.col("plane")), "foreign"),
    )


@query(thick=True, sql="select frame_id, count(*) as points, 0 as twice, 0 as thick, 0 as strangers, 0 as deep from pc group by frame_id")
def patch_rules(pc: DataFrame) -> DataFrame:
    """No pixel of a patch twice, layers at most four apart, both layers' points where their pixel says, depths of eight bits."""
    pixels = rounds.patch_pixels(pc, 5)
    own = projected(pc).select("frame_id", F.col("pt_idx").alias("idx"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("d").alias("pd"), F.col("ppi").alias("p_ppi"), "mode")
    near = pixels.join(own.withColumnRenamed("idx", "idx1"), ["frame_id", "idx1"])
    depth = F.when(F.col("mode") == 1, F.col("min_d") - F.col("pd")).otherwise(F.col("pd") - F.col("min_d"))
    stranger = (F.col("pu") != F.col("u")) | (F.col("pv") != F.col("v")) | (depth != F.col("d1")) | (F.col("p_ppi") != F.col("ppi"))
    rules = near.groupBy("frame_id").agg((F.count("*") - F.count_distinct("patch_id", "u", "v")).cast("int").alias("twice"), F.count_if(~(F.col("d2") - F.col("d1")).between(0, 4)).cast("int").alias("thick"), F.count_if(stranger).cast("int").alias("strangers"), F.count_if(~F.col("d2").between(0, 255)).cast("int").alias("deep"))
    return pc.groupBy("frame_id").agg(F.count("*").alias("points")).join(rules, "frame_id", "left").fillna(0)


def _packed(patches: DataFrame, spots: DataFrame, width: int) -> DataFrame:
    """(frame_id, unplaced, outside, shared_blocks): patches without a place, beyond the map's width, and blocks that two hold."""
    rows = patches.join(spots, ["frame_id", "patch_id"], "left")
    w, h = (F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b)) for a, b in (("h", "w"), ("w", "h")))
    span = lambda at, n, name: F.explode(F.sequence(F.col(at), F.col(at) + n - 1)).alias(name)
    blocks = rows.select("frame_id", "patch_id", h.alias("tall"), "pos_y", span("pos_x", w, "bx")).select("frame_id", "patch_id", "bx", span("pos_y", F.col("tall"), "by"))
    shared = blocks.groupBy("frame_id", "bx", "by").agg(F.count("*").alias("n")).groupBy("frame_id").agg(F.count_if(F.expr("n > 1")).cast("int").alias("shared_blocks"))
    return rows.groupBy("frame_id").agg(F.count_if(F.expr("pos_x is null or discarded")).cast("int").alias("unplaced"), F.count_if(F.col("pos_x") + w > width).cast("int").alias("outside")).join(shared, "frame_id")


PACKED = "select distinct frame_id, 0 as unplaced, 0 as outside, 0 as shared_blocks from pc"


@query(sql=PACKED)
def intra_packing_rules(pc: DataFrame) -> DataFrame:
    boxes = _patches(pc)
    return _packed(boxes, atlas.pack_intra(boxes, 128, 128, 2), 64)


@query(sql=PACKED)
def inter_packing_rules(pc: DataFrame) -> DataFrame:
    boxes = _patches(pc)
    return _packed(boxes, atlas.pack_inter(boxes, 3, 128, 128, 2), 64)


@query(sql="select kind, frame_id, ppi, u, v, max(d) as d from pix, (values ('dilate'), ('grow'), ('pull')) k(kind) group by all")
def fills_keep_pixels(pc: DataFrame) -> DataFrame:
    """Every fill leaves the occupied pixels as they are."""
    fills = {"dilate": dilate_fill, "grow": bbpe_fill, "pull": push_pull_fill}
    spots = projected(pc).select("frame_id", "ppi", "u", "v").distinct()
    out = None
    for kind, work in fills.items():
        value = F.conv(F.hex(F.substring("line", F.col("u") + 1, F.lit(1))), 16, 10).cast("int")
        rows = spots.join(work(pc).withColumnRenamed("y", "v"), ["frame_id", "ppi", "v"]).select(F.lit(kind).alias("kind"), "frame_id", "ppi", "u", "v", value.alias("d"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def coded_images(pc: DataFrame) -> DataFrame:
    """The finished images of all maps: occupancy by block, filled geometry, filled attributes in YUV 4:2:0."""
    return pipeline.encode(pc, PARAMETERS)["images"]


@query()
def low_delay_units(pc: DataFrame) -> DataFrame:
    p = PARAMETERS.changed(low_delay=True)
    return pipeline.all_units(pipeline.encode(pc, p), p)


@query()
def run_statistics(pc: DataFrame) -> DataFrame:
    return pipeline.statistics(pipeline.encode(pc, PARAMETERS), PARAMETERS)


SWEEPS = """, vox as (select frame_id, count(distinct (x >> 1, y >> 1, z >> 1)) as voxels, count(*) as points from pc group by frame_id)
select frame_id, sweep, voxels, voxels as of_classes, 0 as over, 0 as idle, 0 as no_edge_refined from vox, (values (0), (1), (2)) s(sweep)"""


@query(sql=SWEEPS)
def sweep_counters(pc: DataFrame) -> DataFrame:
    """The counters of every sweep of the refinement: classes sum to the voxels; no more is judged than is not skipped, no more changes than is judged."""
    rows = pipeline.sweeps(pc, PARAMETERS)
    sizes = pc.groupBy("frame_id").agg(F.count_distinct(*(F.shiftright(c, 1) for c in "xyz")).alias("voxels"), F.count("*").alias("points"))
    judged = sum(F.col(f"{c}_refined") for c in refine.CLASSES)
    over = (judged > F.col("voxels") - F.col("skipped_voxels")) | (F.col("plane_changes") > F.col("score_computations")) | (F.col("score_computations") > F.col("points"))
    return rows.join(F.broadcast(sizes), "frame_id").select("frame_id", "sweep", "voxels", sum(F.col(c) for c in refine.CLASSES).alias("of_classes"), over.cast("int").alias("over"), ((judged > 0) & (F.col("score_computations") == 0)).cast("int").alias("idle"), "no_edge_refined")


@query()
def sliced_fast(pc: DataFrame) -> DataFrame:
    return pipeline.segmented(pc, PARAMETERS.changed(sliced=True)).select("frame_id", "pt_idx", "ppi")


@query()
def sliced_slow(pc: DataFrame) -> DataFrame:
    return pipeline.segmented(pc, PARAMETERS.changed(sliced=True, preset="slow")).select("frame_id", "pt_idx", "ppi")
