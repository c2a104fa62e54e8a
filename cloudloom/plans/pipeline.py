"""From points to coded units: segmentation, patches, packing, maps, container."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import atlas, codec, container, frames, normals, refine, rounds, tiles, voxel, weave
from ..operators.maps import coloured, occupancy_blocks, on_map
from ..params import Parameters
from ..sources import v3c_file


def segmented(points: DataFrame, p: Parameters) -> DataFrame:
    """points with ppi, by normals or by slices, refined.

    Where voxels are coarser than points, all of this works on voxels, and points take the plane of theirs.
    """
    shift = p.input_depth - p.voxel_depth
    points = points.drop("ppi", "plane")
    if not shift:
        return points.join(_planes(points, p), ["frame_id", "pt_idx"])
    voxels = voxel.voxelize(points, shift)
    cells = voxels.select("frame_id", F.col("vox_id").alias("pt_idx"), *(F.col(f"v{c}").alias(c) for c in "xyz"))
    planes = voxels.join(_planes(cells, p).withColumnRenamed("pt_idx", "vox_id"), ["frame_id", "vox_id"]).select("frame_id", "vx", "vy", "vz", "ppi")
    return voxel.devoxelize(points, planes, shift).drop("vx", "vy", "vz")


def _planes(points: DataFrame, p: Parameters) -> DataFrame:
    """(frame_id, pt_idx, ppi) of points or voxels.

    Slices: the fast preset refines the points that have a plane of their own, and the others take their parents' then; the
    slow one lets them take these first, and refines all.
    """
    keys, shift = ["frame_id", "pt_idx"], p.voxel_depth - p.refine_depth
    if p.sliced:
        rules = (shift, p.sliced_reach, p.indirect_reach + 1, p.sliced_weight, p.sliced_sweeps)
        if p.preset == "slow":
            plane = refine.refined(points.join(weave.sliced_planes(points), keys), *rules, use_normals=False)
        else:
            votes = weave.sliced_votes(points)
            own = points.join(votes.filter("ppi is not null").select(*keys, F.col("ppi").alias("plane")), keys)
            fine = refine.refined(own, *rules, use_normals=False).withColumnRenamed("plane", "fine")
            plane = weave.settled(votes.join(fine, keys, "left").withColumn("ppi", F.coalesce("fine", "ppi")).drop("fine"))
    else:
        rules = (p.normal_neighbours, p.orientation_neighbours, p.diagonal_steps, p.carried_turns)
        found = tiles.oriented(points, *rules, tile=p.tile) if p.tile else normals.with_normals(points, *rules)
        plane = refine.refined(points.join(found, keys), shift, p.refine_reach, p.indirect_reach + 1, p.refine_weight, p.refine_sweeps)
    return plane.select(*keys, F.col("plane").cast("int").alias("ppi"))


def sweeps(points: DataFrame, p: Parameters) -> DataFrame:
    """(frame_id, sweep, refine.COUNTERS) of the refinement by normals, on the voxels that segmented() works on."""
    keys, shift = ["frame_id", "pt_idx"], p.input_depth - p.voxel_depth
    points = points.drop("ppi", "plane")
    if shift:
        points = voxel.voxelize(points, shift).select("frame_id", F.col("vox_id").alias("pt_idx"), *(F.col(f"v{c}").alias(c) for c in "xyz"))
    found = normals.with_normals(points, p.normal_neighbours, p.orientation_neighbours, p.diagonal_steps, p.carried_turns)
    return refine.counters_of(refine.refined_with_counters(points.join(found, keys), p.voxel_depth - p.refine_depth, p.refine_reach, p.indirect_reach + 1, p.refine_weight, p.refine_sweeps))


def boxes(pixels: DataFrame, p: Parameters) -> DataFrame:
    """(frame_id, patch_id, ppi, u, v, w, h, size_d, min_d): each patch's rectangle, w and h in blocks."""
    blocks = lambda c: F.expr(f"(max({c}) - min({c}) + {p.block}) div {p.block}").cast("int")
    return pixels.groupBy("frame_id", "patch_id").agg(F.first("ppi").alias("ppi"), F.min("u").alias("u"), F.min("v").alias("v"), blocks("u").alias("w"), blocks("v").alias("h"), F.max("d2").alias("size_d"), F.first("min_d").alias("min_d"))


def placed(patches: DataFrame, p: Parameters) -> DataFrame:
    if p.mode == "RA":
        spots = atlas.pack_inter(patches, p.gof_size, p.map_width, p.map_height, p.block, p.space, p.iou, p.growing_height)
    else:
        spots = atlas.pack_intra(patches, p.map_width, p.map_height, p.block, p.space, p.growing_height)
    return patches.join(spots.filter("not discarded").drop("discarded"), ["frame_id", "patch_id"])


def map_pixels(points: DataFrame, pixels: DataFrame, patches: DataFrame, p: Parameters) -> DataFrame:
    """(frame_id, x, y, d1, d2, r, g, b): occupied pixels of the geometry and attribute maps."""
    where = patches.select("frame_id", "patch_id", (F.col("pos_x") * p.block).alias("pos_x"), (F.col("pos_y") * p.block).alias("pos_y"), F.col("u").alias("min_u"), F.col("v").alias("min_v"), "swapped")
    return coloured(on_map(pixels, where, ["frame_id", "patch_id"]), points).select("frame_id", "x", "y", "d1", "d2", "r", "g", "b")


def of_frames(points: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of frames; a frame of the points that has none gets one of nulls."""
    return points.select("frame_id").distinct().join(rows, "frame_id", "left")


def encode(points: DataFrame, p: Parameters, coder: codec.MapCodec | None = None) -> dict[str, DataFrame]:
    """All stages' tables for points(frame_id, pt_idx, x, y, z, r, g, b); the parameter sets tell the coder's ids.

    Planes, pixels and patches are read by several later stages, so they are kept as they are first computed (in memory, else
    on disk; what an executor loses is computed anew). `release` lets go of them.
    """
    planes = segmented(points, p).persist()
    pixels = rounds.patch_pixels(planes, p.least_points, propagation=p.propagation, covered=p.covered_distance, block=p.block, distance=p.peak_distance, thickness=p.thickness, double=p.double_layer).persist()
    patches = placed(boxes(pixels, p), p).persist()
    maps = map_pixels(points, pixels, patches, p)
    coded = of_frames(planes, patches).select("frame_id", "patch_id", "pos_x", "pos_y", (F.col("w") - 1).alias("size_x_minus1"), (F.col("h") - 1).alias("size_y_minus1"), F.col("u").alias("offset_u"), F.col("v").alias("offset_v"), F.expr(f"min_d div {p.plane_step}").alias("offset_d"), F.when(F.col("size_d") == 0, 0).otherwise(F.expr(f"(size_d + 1) div {p.plane_step}")).alias("range_d"), F.col("ppi").alias("plane"), F.col("swapped").cast("int").alias("swapped"))
    threshold = p.threshold2 if p.block == 2 else p.threshold4
    units = container.atlas_units(coded, p.gof_size, p.map_width, p.map_height, p.input_depth, 2 if p.double_layer else 1, p.low_delay, p.block, p.plane_step, getattr(coder, "codecs", None), getattr(coder, "group", 1))
    return {"points": planes, "pixels": pixels, "patches": patches, "maps": maps, "occupancy": occupancy_blocks(maps, p.block, threshold), "images": codec.finished(of_frames(planes, maps), p.gof_size, **image_rules(p)), "units": units}


def release(tables: dict[str, DataFrame]) -> None:
    """Frees what encode() keeps."""
    for name in ("points", "pixels", "patches"):
        tables[name].unpersist()


def image_rules(p: Parameters) -> dict[str, object]:
    """What codec.images takes from the parameters."""
    return {"width": p.map_width, "height": p.map_height, "block": p.block, "layers": 2 if p.double_layer else 1, "threshold": p.threshold2 if p.block == 2 else p.threshold4, "geometry": p.background_geometry, "attribute": p.background_attribute, "fill_": p.fill, "fill_block": p.fill_block, "filtered_chroma": p.filtered_chroma}


def statistics(tables: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """The counters of each frame: points, voxels, points of each plane, patches, their pixels in both layers, lost points, map height."""
    points = frames.statistics(tables["points"], ["frame_id"])
    voxels = voxel.with_voxel(tables["points"], p.input_depth - p.voxel_depth).groupBy("frame_id").agg(F.count_distinct("vx", "vy", "vz").alias("voxels"))
    layers = tables["pixels"].groupBy("frame_id").agg(F.count_distinct("patch_id").alias("patches"), F.count("*").alias("near_pixels"), F.count_if(F.expr("idx1 <> idx2")).alias("far_pixels"))
    kept = tables["pixels"].select("frame_id", "idx1").union(tables["pixels"].select("frame_id", "idx2")).distinct().groupBy("frame_id").agg(F.count("*").alias("kept_points"))
    spots = tables["patches"].groupBy("frame_id").agg(F.count("*").alias("placed_patches"), F.max(F.col("pos_y") + F.when(F.col("swapped"), F.col("w")).otherwise(F.col("h"))).alias("used_rows"))
    occupied = tables["occupancy"].groupBy("frame_id").agg(F.count_if(F.expr("occupied")).alias("occupied_blocks"), F.sum(F.when(F.col("occupied"), 0).otherwise(F.col("filled"))).alias("zeroed_pixels"))
    out = points
    for more in (voxels, layers, kept, spots, occupied):
        out = out.join(more, "frame_id", "left")
    return out.fillna(0).withColumn("lost_points", F.col("points") - F.col("kept_points"))


def all_units(tables: dict[str, DataFrame], p: Parameters, coder: codec.MapCodec | None = None) -> DataFrame:
    """Parameter, atlas and map units in one table; (gof_id, unit_seq) is their order in a file."""
    rules = image_rules(p)
    make = codec.low_delay_units if p.low_delay else codec.video_units
    if hasattr(coder, "configured"):
        coder = coder.configured({kind: p.codec_options(kind) for kind in codec.MAPS})
    return tables["units"].unionByName(make(of_frames(tables["points"], tables["maps"]), p.gof_size, rules.pop("width"), rules.pop("height"), rules.pop("block"), coder, **rules))


def write_file(units: DataFrame, path: str) -> int:
    """All units in order as one file, written in parallel where tasks can write into it, else in parts; its bytes."""
    return v3c_file.write(units, path)
