"""One query for each relational operator over the derived clouds, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import scalar as sc
from ..operators import components, frames, maps, matching, neighbors, patches, slices, voxel
from . import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PATCH = ["frame_id", "ppi"]  # a face of the box is a patch of the derived cloud


def query(sql: str | None = None, thick: bool = False, table: str = "pc"):
    """Registers f(rows) under its name; sql may name pc, and begins after the CTEs that define it."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(derived.cloud(spark, sf_dir, thick) if table == "pc" else spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            if table != "pc":
                ORACLES[f.__name__] = sql
            else:
                sql_ = sql.strip()
                ORACLES[f.__name__] = f"with {derived.oracle(thick)}" + (f",\n{sql_[5:]}" if sql_.startswith("with ") else f"\n{sql_}")
        return f

    return add


VOXELS = """with vox as (select frame_id, x >> 2 as vx, y >> 2 as vy, z >> 2 as vz, count(*) as n, min(pt_idx) as first_idx,
 count(*) filter (ppi = 0) as s0, count(*) filter (ppi = 1) as s1, count(*) filter (ppi = 2) as s2, count(*) filter (ppi = 3) as s3, count(*) filter (ppi = 4) as s4, count(*) filter (ppi = 5) as s5
 from pc group by all),
voxels as (select *, row_number() over (partition by frame_id order by first_idx) - 1 as vox_id,
 list_position([s0, s1, s2, s3, s4, s5], greatest(s0, s1, s2, s3, s4, s5)) - 1 as ppi,
 case when n = 1 then 'S' when (s0 > 0)::int + (s1 > 0)::int + (s2 > 0)::int + (s3 > 0)::int + (s4 > 0)::int + (s5 > 0)::int = 1 then 'NO_EDGE' else 'M' end as vox_class from vox)"""


def voxels_of(pc: DataFrame) -> DataFrame:
    own = voxel.classify(voxel.majority(voxel.histogram(pc, 2)))
    return own.join(voxel.voxelize(pc, 2), ["frame_id", "vx", "vy", "vz"])


@query("""with h as (select frame_id, x >> 1 as vx, y >> 1 as vy, z >> 1 as vz, list_transform(range(6), lambda k: count(*) filter (ppi = 0) * (k = 0)::int + count(*) filter (ppi = 1) * (k = 1)::int + count(*) filter (ppi = 2) * (k = 2)::int + count(*) filter (ppi = 3) * (k = 3)::int + count(*) filter (ppi = 4) * (k = 4)::int + count(*) filter (ppi = 5) * (k = 5)::int) as s, count(*) as n from pc group by all)
select frame_id, (list_position(s, list_max(s)) - 1)::int as ppi, count(*) as voxels, sum(n)::bigint as points from h group by all""")
def voxel_majority_ppi_summary(pc: DataFrame) -> DataFrame:
    own = voxel.majority(voxel.histogram(voxel.in_range(pc, derived.DEPTH), 1))
    return own.groupBy("frame_id", "ppi").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"))


@query("select frame_id, pt_idx from pc where x < 32 and y < 32 and z < 32")
def range_filter(pc: DataFrame) -> DataFrame:
    return voxel.in_range(pc, 5).select("frame_id", "pt_idx")


@query("select frame_id, pt_idx, (r & 65535)::int as r, (g & 255)::int as g from pc")
def typed_projection(pc: DataFrame) -> DataFrame:
    return pc.select("frame_id", "pt_idx", F.col("r").bitwiseAND(65535).alias("r"), F.col("g").bitwiseAND(255).alias("g"))


@query("select frame_id, pt_idx, x + 1 - y as ax, y + 2 - z as ay, -(z + 3 - x) as az, (x * 3 + y * 5 + z * 7) as d, (x // 3)::int as qx from pc")
def vector_arithmetic(pc: DataFrame) -> DataFrame:
    p = tuple(F.col(c) for c in "xyz")
    moved = sc.subtract(sc.add(p, (F.lit(1), F.lit(2), F.lit(3))), (F.col("y"), F.col("z"), F.col("x")))
    return pc.select("frame_id", "pt_idx", moved[0].alias("ax"), moved[1].alias("ay"), sc.negate(moved)[2].alias("az"), sc.dot(p, (F.lit(3), F.lit(5), F.lit(7))).alias("d"), sc.scaled(p, F.lit(3))[0].alias("qx"))


@query("select frame_id, pt_idx, ((x + 7) & -8)::int as up8, ((y + 63) & -64)::int as up64, case when pt_idx < 10000 then lpad(pt_idx::varchar, 4, '0') else pt_idx::varchar end as padded from pc")
def round_up_and_pad(pc: DataFrame) -> DataFrame:
    return pc.select("frame_id", "pt_idx", sc.round_up(F.col("x"), 8).alias("up8"), sc.round_up(F.col("y"), 64).alias("up64"), sc.zero_pad(F.col("pt_idx"), 4).alias("padded"))


@query("select frame_id, pt_idx, x::bigint + (y::bigint << 6) + (z::bigint << 12) as key, x + (y << 6)::bigint as key2, x as ux, y as uy, z as uz from pc")
def pack_location(pc: DataFrame) -> DataFrame:
    key = sc.pack(F.col("x"), F.col("y"), F.col("z"), 6)
    ux, uy, uz = sc.unpack(key, 6)
    return pc.select("frame_id", "pt_idx", key.alias("key"), sc.pack2(F.col("x"), F.col("y"), 6).alias("key2"), ux.alias("ux"), uy.alias("uy"), uz.alias("uz"))


AXES = """with ax as (select *, [0, 1, 2, 0, 1, 2][ppi + 1] as na, [2, 2, 0, 2, 2, 0][ppi + 1] as ta, [1, 0, 1, 1, 0, 1][ppi + 1] as ba, [0, 0, 0, 1, 1, 1][ppi + 1] as mode from pc),
pix as (select *, [x, y, z][ta + 1] as u, [x, y, z][ba + 1] as v, [x, y, z][na + 1] as d, case when mode = 1 then -[x, y, z][na + 1] else [x, y, z][na + 1] end as near from ax)"""


@query(f"{AXES} select frame_id, pt_idx, u, v, d, mode, case when mode = 1 then 64 - d else d end as rel, case when na = 0 then 1 - 2 * mode else 0 end as nx from pix")
def ppi_axes(pc: DataFrame) -> DataFrame:
    pixels = patches.projected(pc)
    return pixels.select("frame_id", "pt_idx", "u", "v", "d", "mode", sc.relative_depth(F.col("mode"), F.col("d"), F.when(F.col("mode") == 1, 64).otherwise(0)).alias("rel"), F.element_at(sc.plane_normal(F.col("ppi")), 1).alias("nx"))


@query("select distinct r, case when r = 0 then -1 else length(bin(r)) - 1 end as fl, case when r = 0 then -1 when r = 1 then 0 else length(bin(r - 1)) end as cl from pc")
def integer_logarithms(pc: DataFrame) -> DataFrame:
    return pc.select("r", sc.floor_log2(F.col("r")).alias("fl"), sc.ceil_log2(F.col("r")).alias("cl")).distinct()


@query("select distinct r as n, repeat('0', length(bin(r + 1)) - 1) || bin(r + 1) as code, 2 * length(bin(r + 1)) - 1 as bits, right(lpad(bin(r), 64, '0'), 5) as low5, right(lpad(bin(r), 64, '0'), 9) as u9 from pc")
def ue_codes(pc: DataFrame) -> DataFrame:
    n = F.col("r")
    return pc.select(n.alias("n"), bits.ue(n).alias("code"), bits.ue_length(n).alias("bits"), bits.u(n, 5).alias("low5"), bits.u(n, 9).alias("u9")).distinct()


@query("""with c as (select distinct r as n, repeat('0', length(bin(r + 1)) - 1) || bin(r + 1) as code from pc)
select n, code || '1' || repeat('0', (8 - (length(code) + 1) % 8) % 8) as ended, case when length(code) % 8 = 0 then code else code || '1' || repeat('0', (8 - (length(code) + 1) % 8) % 8) end as aligned from c""")
def trailing_bits(pc: DataFrame) -> DataFrame:
    return pc.select(F.col("r").alias("n"), bits.ue(F.col("r")).alias("code")).distinct().select("n", bits.trailing(F.col("code")).alias("ended"), bits.aligned(F.col("code")).alias("aligned"))


@query("select frame_id, count(*) as n, lpad(lower(hex(count(*))), 10, '0') as field, count(*) as back from pc group by frame_id")
def unit_length_field(pc: DataFrame) -> DataFrame:
    return pc.groupBy("frame_id").agg(F.count("*").alias("n")).select("frame_id", "n", F.lower(F.hex(bits.big_endian(F.col("n"), 5))).alias("field"), bits.from_big_endian(bits.big_endian(F.col("n"), 5)).alias("back"))


@query("select max(n) as largest, least(greatest(ceil((case when max(n) = 1 then 0 else length(bin(max(n) - 1)) end) / 8.0), 1), 8)::int as bytes from (select count(*) as n from pc group by frame_id)")
def unit_precision(pc: DataFrame) -> DataFrame:
    return pc.groupBy("frame_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest")).select("largest", frames.precision_bytes(F.col("largest")).alias("bytes"))


@query("with n as (select frame_id, ppi, count(*) as size from pc group by all) select frame_id, ppi, size, (sum(size + 4) over (partition by frame_id order by ppi) - size)::bigint as \"offset\" from n")
def unit_offsets(pc: DataFrame) -> DataFrame:
    return frames.offsets(pc.groupBy("frame_id", "ppi").agg(F.count("*").alias("size")), ["frame_id"], "ppi", "size", 4)


@query("select frame_id, pt_idx, greatest(10, least(40, x)) as cx, ((r + 2 * g + 3 * b) // 6)::int as mean, (x >> 6)::int as qp, ((y + 1) >> 6)::int as qs from pc")
def clamp_and_quantise(pc: DataFrame) -> DataFrame:
    return pc.select("frame_id", "pt_idx", sc.clamp(F.col("x"), 10, 40).alias("cx"), sc.mean_of_four([(F.col("r"), 1), (F.col("g"), 2), (F.col("b"), 3)]).alias("mean"), sc.quantise_position(F.col("x")).alias("qp"), sc.quantise_size(F.col("y")).alias("qs"))


@query("""with w as (select frame_id, pt_idx, [g - b, r - g, b - g, g - r] as v from pc)
select frame_id, pt_idx, [4, 5, 1, 2][list_position(v, list_max(v))] as face from w""")
def direction_to_plane(pc: DataFrame) -> DataFrame:
    return pc.select("frame_id", "pt_idx", sc.direction_plane(F.col("g") - F.col("r"), F.col("g") - F.col("b"), 0).alias("face"))


NAMES = ["geoBitDepthInput", "presetName", "sizeGOP", "rate", "mapWidth"]


TEXTS = """with t as (select o_orderkey as k, (o_orderkey % 50)::varchar || '-' || (o_orderkey % 40)::varchar || '-' || (case when o_orderkey % 3 = 0 then 'x' else (o_orderkey % 5)::varchar end) as rate, case o_orderkey % 5 when 0 then 'true' when 1 then '12' when 2 then '-7.5' when 3 then 'RA' else '3a' end as v from orders)"""


def _texts(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    rate = F.concat_ws("-", (k % 50).cast("string"), (k % 40).cast("string"), F.when(k % 3 == 0, "x").otherwise((k % 5).cast("string")))
    v = F.when(k % 5 == 0, "true").when(k % 5 == 1, "12").when(k % 5 == 2, "-7.5").when(k % 5 == 3, "RA").otherwise("3a")
    return orders.select(k.alias("k"), rate.alias("rate"), v.alias("v"))


@query(f"""{TEXTS} select k, case when regexp_full_match(rate, '\\d+-\\d+-\\d+') then regexp_extract(rate, '^(\\d+)', 1)::int else -1 end as gqp, case when regexp_full_match(rate, '\\d+-\\d+-\\d+') then regexp_extract(rate, '(\\d+)$', 1)::int else -1 end as block,
 case when v = '12' then 12 else -1 end::bigint as i, case when v in ('12', '-7.5') then v::double end as d, case when v = 'true' then true end as b, v in ('AI', 'RA') as is_mode from t""", table="orders")
def parse_parameters(orders: DataFrame) -> DataFrame:
    r, v = sc.rate(F.col("rate")), F.col("v")
    return _texts(orders).select("k", F.coalesce(r["geometry_qp"], F.lit(-1)).alias("gqp"), F.coalesce(r["block"], F.lit(-1)).alias("block"), F.coalesce(sc.strict_int(v), F.lit(-1).cast("long")).alias("i"), sc.strict_double(v).alias("d"), sc.strict_bool(v).alias("b"), sc.is_one_of(v, ["AI", "RA"]).alias("is_mode"))


@query("""select c_custkey as k, (c_custkey % 7)::varchar as a, 'x' as mode from customer""", table="customer")
def key_value_pairs(customer: DataFrame) -> DataFrame:
    m = sc.key_values(F.concat(F.lit("a="), (F.col("c_custkey") % 7).cast("string"), F.lit(",mode=x,mode=y")))
    return customer.select(F.col("c_custkey").alias("k"), m["a"].alias("a"), m["mode"].alias("mode"))


@query("""with n as (select unnest(['geoBitDepthInput', 'mapWidth', 'presetName', 'rate', 'sizeGOP']) as name), c as (select p_partkey, substr(p_name, 1, 8) as t from part),
d as (select p_partkey, name, row_number() over (partition by p_partkey order by levenshtein(t, name), name) as r from c, n)
select p_partkey, name as nearest from d where r = 1""", table="part")
def nearest_parameter_name(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", sc.nearest_name(F.substring("p_name", 1, 8), NAMES).alias("nearest"))


@query("""with e as (select r as frame_id from range(0, 24) t(r)) select frame_id::int as frame_id, 'seq_vox6_' || lpad((3 + frame_id % 12)::varchar, 4, '0') || '.ply' as path, 6 as voxel from e""")
def frame_paths(pc: DataFrame) -> DataFrame:
    rows = frames.paths(pc.sparkSession, "seq_vox6_%04d.ply", 3, 12, 2)
    return rows.select("frame_id", "path", frames.from_name(F.col("path"))["voxel"].alias("voxel"))


@query("select distinct frame_id, (frame_id // 3)::int as gof_id, frame_id % 3 as place from pc")
def gof_assign(pc: DataFrame) -> DataFrame:
    return frames.grouped(pc.select("frame_id").distinct(), 3).select("frame_id", F.col("gof_id").cast("int").alias("gof_id"), "place")


@query("select frame_id, count(*) as points, count(distinct ppi) as planes, count(*) filter (ppi = 0) as plane0, count(*) filter (ppi = 1) as plane1, count(*) filter (ppi = 2) as plane2, count(*) filter (ppi = 3) as plane3, count(*) filter (ppi = 4) as plane4, count(*) filter (ppi = 5) as plane5 from pc group by frame_id")
def stats_counters(pc: DataFrame) -> DataFrame:
    return frames.statistics(pc, ["frame_id"])


@query(f"{VOXELS} select frame_id, vox_id, vx, vy, vz, first_idx from voxels")
def voxelize(pc: DataFrame) -> DataFrame:
    return voxel.voxelize(pc, 2)


@query(f"{VOXELS} select p.frame_id, p.pt_idx, v.vox_id from pc p join voxels v on p.frame_id = v.frame_id and p.x >> 2 = v.vx and p.y >> 2 = v.vy and p.z >> 2 = v.vz")
def devoxelize(pc: DataFrame) -> DataFrame:
    return voxel.devoxelize(pc, voxel.voxelize(pc, 2), 2).select("frame_id", "pt_idx", "vox_id")


@query(f"{VOXELS} select frame_id, vx, vy, vz, n, s0, s1, s2, s3, s4, s5, ppi::int as ppi, vox_class from voxels")
def voxel_histogram_class(pc: DataFrame) -> DataFrame:
    return voxel.classify(voxel.majority(voxel.histogram(pc, 2)))


OFFSETS = "offs as (select dx, dy, dz, dx * dx + dy * dy + dz * dz as d2 from range(-3, 4) a(dx), range(-3, 4) b(dy), range(-3, 4) c(dz))"
EXTENDED = f"""{VOXELS}, {OFFSETS}, ext as (select v.frame_id, v.vox_id, sum(w.n) as nn, {', '.join(f'sum(w.s{k}) as e{k}' for k in range(6))} from voxels v, offs o, voxels w
 where o.d2 between 1 and 2 and w.frame_id = v.frame_id and w.vx = v.vx + dx and w.vy = v.vy + dy and w.vz = v.vz + dz group by all),
full_ext as (select v.*, coalesce(nn, 0)::bigint as nn, {', '.join(f'coalesce(e{k}, 0)::bigint as e{k}' for k in range(6))} from voxels v left join ext e on v.frame_id = e.frame_id and v.vox_id = e.vox_id)"""


@query(f"{EXTENDED} select frame_id, vox_id, nn, e0, e1, e2, e3, e4, e5 from full_ext")
def extended_score(pc: DataFrame) -> DataFrame:
    return neighbors.extended_score(voxels_of(pc), 2).select("frame_id", "vox_id", "nn", *(f"e{k}" for k in range(6)))


@query(f"{EXTENDED} select frame_id, vox_id from full_ext where vox_class <> 'M' and (e0 > 0)::int + (e1 > 0)::int + (e2 > 0)::int + (e3 > 0)::int + (e4 > 0)::int + (e5 > 0)::int = 1 and [e0, e1, e2, e3, e4, e5][ppi + 1] > 0")
def nev_filter(pc: DataFrame) -> DataFrame:
    return neighbors.extended_score(voxels_of(pc), 2).filter(neighbors.is_settled()).select("frame_id", "vox_id")


def _smooth_sql(score: str) -> str:
    normals = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1]]
    dots = [[sum(a * b for a, b in zip(n, m)) for n in normals] for m in normals]
    parts = ", ".join(score.format(k=k, dot=f"{dots[k]}[ppi + 1]") for k in range(6))
    return f"{EXTENDED}, sc as (select frame_id, vox_id, nn, [{parts}] as s from full_ext) select frame_id, vox_id, case when nn = 0 then 0 else list_position(s, list_max(s)) - 1 end::int as smoothed from sc"


@query(_smooth_sql("3.5::double / nn * e{k} + {dot}"))
def smooth_argmax_round1(pc: DataFrame) -> DataFrame:
    return neighbors.extended_score(voxels_of(pc), 2).select("frame_id", "vox_id", neighbors.smoothed_plane(3.5).cast("int").alias("smoothed"))


@query(_smooth_sql("3.5::double * e{k} + case when vox_class = 'M' then 0 else {dot} * nn end"))
def smooth_argmax_unscaled(pc: DataFrame) -> DataFrame:
    return neighbors.extended_score(voxels_of(pc), 2).select("frame_id", "vox_id", neighbors.unscaled_plane(3.5, F.col("vox_class") != "M").cast("int").alias("smoothed"))


@query("with p as (select frame_id, pt_idx, x - 28 as nx, y - 28 as ny, z - 28 as nz from pc), s as (select frame_id, pt_idx, [nx, ny, nz, -nx, -ny, -nz] as d from p) select frame_id, pt_idx, list_position(d, list_max(d)) - 1 as plane from s")
def initial_segmentation(pc: DataFrame) -> DataFrame:
    normal = [F.col(c) - 28 for c in "xyz"]
    return pc.select("frame_id", "pt_idx", sc.argmax_first(F.array(*normal, *sc.negate(tuple(normal)))).alias("plane"))


PAIRS = f"{OFFSETS}, pairs as (select p.frame_id, p.pt_idx as src, q.pt_idx as dst, p.ppi, d2 from pc p, offs o, pc q where d2 between 1 and 3 and q.frame_id = p.frame_id and q.ppi = p.ppi and q.x = p.x + dx and q.y = p.y + dy and q.z = p.z + dz)"


@query(f"with {PAIRS} select frame_id, ppi, count(*) as pairs, sum(d2)::bigint as d2, sum(src)::bigint as src, sum(dst)::bigint as dst from pairs group by all")
def neighbor_pairs(pc: DataFrame) -> DataFrame:
    pairs = neighbors.neighbour_pairs(pc, 3)
    return pairs.groupBy("frame_id", "ppi").agg(F.count("*").alias("pairs"), F.sum("d2").alias("d2"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


KNN = """with cand as (select p.frame_id, p.pt_idx, q.pt_idx as nb, (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 as d2, q.x, q.y, q.z from pc p join pc q on p.frame_id = q.frame_id and abs(p.x - q.x) <= 9 and abs(p.y - q.y) <= 9 and abs(p.z - q.z) <= 9),
knn as (select *, row_number() over (partition by frame_id, pt_idx order by d2, nb) as rank from cand qualify rank <= 6)"""


@query(f"{KNN} select frame_id, pt_idx, rank, nb, d2::bigint as d2 from knn")
def knn_topk(pc: DataFrame) -> DataFrame:
    return neighbors.knn(pc, 6)


@query(f"{KNN} select frame_id, pt_idx, sum(x)::bigint as sx, sum(y)::bigint as sy, sum(z)::bigint as sz, sum(x * x)::bigint as sxx, sum(x * y)::bigint as sxy, round(covar_samp(x, z), 6) + 0.0 as cxz, round(avg(x), 6) as mx from knn group by all")
def knn_barycenter(pc: DataFrame) -> DataFrame:
    near = neighbors.knn(pc, 6).select("frame_id", "pt_idx", "nb").join(pc.select("frame_id", F.col("pt_idx").alias("nb"), "x", "y", "z"), ["frame_id", "nb"])
    return near.groupBy("frame_id", "pt_idx").agg(*(F.sum(c).alias(f"s{c}") for c in "xyz"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), (F.round(F.covar_samp("x", "z"), 6) + 0.0).alias("cxz"), F.round(F.avg("x"), 6).alias("mx"))


COMPONENTS = f"with recursive {{pc}}, {PAIRS.replace('pairs as (', 'pairs as materialized (')}, reach as (select frame_id, pt_idx as root, pt_idx as node from pc union select r.frame_id, r.root, p.dst from reach r join pairs p on p.frame_id = r.frame_id and p.src = r.node and p.dst > r.root), comp as (select frame_id, node as pt_idx, min(root) as component from reach group by all)"


@query()
def components_26(pc: DataFrame) -> DataFrame:
    return components.components(pc).select("frame_id", "pt_idx", "component")


@query()
def component_size_filter(pc: DataFrame) -> DataFrame:
    return components.large_enough(components.components(pc), 16)


ORACLES["components_26"] = COMPONENTS.format(pc=derived.oracle()) + " select frame_id, pt_idx, component from comp"
ORACLES["component_size_filter"] = COMPONENTS.format(pc=derived.oracle()) + " select c.frame_id, c.component, min(p.ppi) as ppi, count(*) as points from comp c join pc p on c.frame_id = p.frame_id and c.pt_idx = p.pt_idx group by c.frame_id, c.component having count(*) >= 16"


BY_COMPONENT = f"{COMPONENTS.format(pc=derived.oracle())}, {AXES[5:]}, own as (select p.*, c.component from pix p join comp c on c.frame_id = p.frame_id and c.pt_idx = p.pt_idx)"


def _by_component(pc: DataFrame) -> DataFrame:
    return patches.projected(pc).join(components.components(pc).select("frame_id", "pt_idx", "component"), ["frame_id", "pt_idx"])


@query()
def component_bbox(pc: DataFrame) -> DataFrame:
    return patches.bounding_boxes(_by_component(pc), ["frame_id", "component"])


@query()
def component_near_layer(pc: DataFrame) -> DataFrame:
    """The near layer of each component's pixels that is not too far from the peak of its block."""
    pixels, patch = _by_component(pc), ["frame_id", "component"]
    near = patches.near_layer(pixels, patch)
    return patches.near_their_peak(near, patches.block_peaks(pixels, patch, 4), patches.bounding_boxes(pixels, patch), patch, 4, 2).select(*patch, "u", "v", "d1", "idx1")


ORACLES["component_bbox"] = f"{BY_COMPONENT} select frame_id, component, min(u) as min_u, max(u) as max_u, min(v) as min_v, max(v) as max_v from own group by all"
ORACLES["component_near_layer"] = f"""{BY_COMPONENT}, cell as (select *, (u - min(u) over w) // 4 as bu, (v - min(v) over w) // 4 as bv from own window w as (partition by frame_id, component)),
 peaks as (select frame_id, component, bu, bv, abs(min(near)) as peak from cell group by all), near_layer as (select * from cell qualify row_number() over (partition by frame_id, component, u, v order by near, pt_idx) = 1)
 select n.frame_id, n.component, u, v, d as d1, pt_idx as idx1 from near_layer n join peaks q on n.frame_id = q.frame_id and n.component = q.component and n.bu = q.bu and n.bv = q.bv where abs(d - peak) <= 2"""


@query(f"{AXES} select frame_id, ppi, min(u) as min_u, max(u) as max_u, min(v) as min_v, max(v) as max_v from pix group by all")
def patch_bbox(pc: DataFrame) -> DataFrame:
    return patches.bounding_boxes(patches.projected(pc), PATCH)


PEAKS = f"{AXES}, cell as (select *, (u - min(u) over (partition by frame_id, ppi)) // 4 as bu, (v - min(v) over (partition by frame_id, ppi)) // 4 as bv from pix), peaks as (select frame_id, ppi, mode, bu, bv, abs(min(near)) as peak from cell group by all)"


@query(f"{PEAKS} select * from peaks")
def patch_block_peak(pc: DataFrame) -> DataFrame:
    return patches.block_peaks(patches.projected(pc), PATCH, 4)


PLANES = f"{PEAKS}, planes as (select frame_id, ppi, mode, case when mode = 1 then (max(peak) + 63) & -64 else min(peak) // 64 * 64 end as min_d from peaks group by frame_id, ppi, mode)"


@query(f"{PLANES} select frame_id, ppi, mode, min_d::int as min_d from planes")
def patch_plane(pc: DataFrame) -> DataFrame:
    return patches.planes(patches.block_peaks(patches.projected(pc), PATCH, 4), PATCH).withColumn("min_d", F.col("min_d").cast("int"))


NEAR = f"{PLANES}, near_layer as (select frame_id, ppi, u, v, mode, d as d1, pt_idx as idx1 from pix qualify row_number() over (partition by frame_id, ppi, u, v order by near, pt_idx) = 1)"


@query(f"{NEAR} select * from near_layer", thick=True)
def depth_l1(pc: DataFrame) -> DataFrame:
    return patches.near_layer(patches.projected(pc), PATCH)


@query(f"{NEAR} select p.frame_id, p.ppi, p.u, p.v, p.d as d2, case when p.d = d1 then idx1 else p.pt_idx end as idx2 from pix p join near_layer n on p.frame_id = n.frame_id and p.ppi = n.ppi and p.u = n.u and p.v = n.v where abs(p.d - d1) <= 4 qualify row_number() over (partition by p.frame_id, p.ppi, p.u, p.v order by abs(p.d - d1) desc, p.pt_idx) = 1", thick=True)
def depth_l2(pc: DataFrame) -> DataFrame:
    pixels = patches.projected(pc)
    return patches.far_layer(pixels, patches.near_layer(pixels, PATCH), PATCH)


@query(f"{NEAR} select p.frame_id, case when abs(p.d - d1) = 0 then 'near' when abs(p.d - d1) <= 4 then 'far' when abs(p.d - d1) <= 5 then 'dropped' else 'again' end as fate, count(*) as points from pix p join near_layer n on p.frame_id = n.frame_id and p.ppi = n.ppi and p.u = n.u and p.v = n.v group by all", thick=True)
def layer_rules(pc: DataFrame) -> DataFrame:
    pixels = patches.projected(pc)
    return patches.layer_fate(pixels, patches.near_layer(pixels, PATCH), PATCH).groupBy("frame_id", "fate").agg(F.count("*").alias("points"))


@query(f"{NEAR} select p.frame_id, p.ppi, count(*) as pixels, max(case when p.mode = 1 then min_d - d1 else d1 - min_d end)::int as size_d from near_layer p join planes q on p.frame_id = q.frame_id and p.ppi = q.ppi where case when p.mode = 1 then min_d - d1 else d1 - min_d end <= 251 group by all", thick=True)
def depth_overflow_filter(pc: DataFrame) -> DataFrame:
    pixels = patches.projected(pc)
    planes_ = patches.planes(patches.block_peaks(pixels, PATCH, 4), PATCH)
    kept = patches.within_depth(patches.near_layer(pixels, PATCH), planes_, PATCH)
    return kept.groupBy(*PATCH).agg(F.count("*").alias("pixels"), F.max(sc.relative_depth(F.col("mode"), F.col("d1"), F.col("min_d"))).cast("int").alias("size_d"))


@query(f"{NEAR} select n.frame_id, n.ppi, n.u, n.v, n.idx1 from near_layer n join cell c on c.frame_id = n.frame_id and c.pt_idx = n.idx1 join peaks q on c.frame_id = q.frame_id and c.ppi = q.ppi and c.bu = q.bu and c.bv = q.bv where abs(n.d1 - q.peak) <= 2", thick=True)
def peak_distance_filter(pc: DataFrame) -> DataFrame:
    pixels = patches.projected(pc)
    near, boxes = patches.near_layer(pixels, PATCH), patches.bounding_boxes(pixels, PATCH)
    return patches.near_their_peak(near, patches.block_peaks(pixels, PATCH, 4), boxes, PATCH, 4, 2).select(*PATCH, "u", "v", "idx1")


SORTED = f"{AXES}, box as (select frame_id, ppi, max(u) - min(u) + 1 + ppi * 3 as w, max(v) - min(v) + 1 + 17 - ppi as h from pix group by frame_id, ppi)"


def _boxes(pc: DataFrame) -> DataFrame:
    box = patches.bounding_boxes(patches.projected(pc), PATCH)
    return box.select(*PATCH, (F.col("max_u") - F.col("min_u") + 1 + F.col("ppi") * 3).alias("w"), (F.col("max_v") - F.col("min_v") + 18 - F.col("ppi")).alias("h"), "min_u", "min_v")


@query(f"{SORTED} select *, row_number() over (partition by frame_id order by greatest(w, h) desc, ppi) as place from box")
def patch_sort(pc: DataFrame) -> DataFrame:
    return patches.by_size(_boxes(pc).select(*PATCH, "w", "h"), "ppi", ["frame_id"])


@query(f"{NEAR} select frame_id, count(*) as lost from pix p where not exists (select 1 from near_layer n where n.frame_id = p.frame_id and n.idx1 = p.pt_idx) group by all", thick=True)
def lost_points(pc: DataFrame) -> DataFrame:
    near = patches.near_layer(patches.projected(pc), PATCH).select("frame_id", F.col("idx1").alias("pt_idx"))
    return patches.lost(pc, near).groupBy("frame_id").agg(F.count("*").alias("lost"))


COVERED = f"""{NEAR}, far_layer as (select p.frame_id, case when p.d = d1 then idx1 else p.pt_idx end as idx2 from pix p join near_layer n on p.frame_id = n.frame_id and p.ppi = n.ppi and p.u = n.u and p.v = n.v
  where abs(p.d - d1) <= 4 qualify row_number() over (partition by p.frame_id, p.ppi, p.u, p.v order by abs(p.d - d1) desc, p.pt_idx) = 1),
 layers as (select frame_id, idx1 as pt_idx from near_layer union select frame_id, idx2 from far_layer), kept as (select p.frame_id, p.pt_idx, p.x, p.y, p.z from pc p join layers l on p.frame_id = l.frame_id and p.pt_idx = l.pt_idx),
 {OFFSETS}, hit as (select distinct p.frame_id, p.pt_idx from pc p, offs o, kept q where d2 between 1 and 5 and q.frame_id = p.frame_id and q.x = p.x + dx and q.y = p.y + dy and q.z = p.z + dz)"""


def _layers(pc: DataFrame) -> DataFrame:
    """The points of both layers of all patches: what later rounds find covered."""
    pixels = patches.projected(pc)
    near = patches.near_layer(pixels, PATCH)
    far = patches.far_layer(pixels, near, PATCH)
    return near.select("frame_id", F.col("idx1").alias("pt_idx")).union(far.select("frame_id", "idx2")).distinct()


@query(f"{COVERED} select frame_id, pt_idx from hit", thick=True)
def covered_semi(pc: DataFrame) -> DataFrame:
    return patches.covered(pc, _layers(pc)).select("frame_id", "pt_idx")


@query(f"{COVERED} select frame_id, pt_idx from pc where (frame_id, pt_idx) not in (select (frame_id, pt_idx) from hit)", thick=True)
def seed_anti(pc: DataFrame) -> DataFrame:
    return patches.covered(pc, _layers(pc), anti=True).select("frame_id", "pt_idx")


MOVED = f"{AXES}, box as (select frame_id, ppi as patch_id, ppi, (min(u) + frame_id * 2)::int as x, min(v)::int as y, (max(u) - min(u) + 1)::int as w, (max(v) - min(v) + 1 + frame_id)::int as h from pix group by frame_id, ppi)"


def _moved(pc: DataFrame) -> DataFrame:
    box = patches.bounding_boxes(patches.projected(pc), PATCH)
    return box.select("frame_id", F.col("ppi").alias("patch_id"), "ppi", (F.col("min_u") + F.col("frame_id") * 2).alias("x"), F.col("min_v").alias("y"), (F.col("max_u") - F.col("min_u") + 1).alias("w"), (F.col("max_v") - F.col("min_v") + 1 + F.col("frame_id")).alias("h"))


CANDIDATES = f"""{MOVED}, iou as (select n.frame_id, n.patch_id, p.patch_id as previous_id, greatest(0, least(n.x + n.w, p.x + p.w) - greatest(n.x, p.x)) * greatest(0, least(n.y + n.h, p.y + p.h) - greatest(n.y, p.y)) as shared, n.w * n.h + p.w * p.h as total
 from box n join box p on n.frame_id = p.frame_id + 1 and n.ppi % 3 = p.ppi % 3 where n.frame_id % 3 <> 0), cand as (select frame_id, patch_id, previous_id, shared::float / (total - shared)::float as iou from iou where shared::float / (total - shared)::float > 0.3::float)"""


@query(f"{CANDIDATES} select frame_id, patch_id, previous_id, round(iou::double, 6) as iou from cand")
def match_candidates(pc: DataFrame) -> DataFrame:
    return matching.candidates(_moved(pc), 3, 0.3).withColumn("iou", F.round(F.col("iou").cast("double"), 6))


@query(f"""{CANDIDATES}, link as (select * from cand where patch_id = previous_id),
chain as (select b.frame_id // 3 as gof_id, b.patch_id, count(*) as frames, max(w) as w, max(h) as h, min(b.frame_id) as f0 from box b group by all)
select gof_id, f0::bigint * 1048576 + patch_id as union_id, frames, w, h from chain where frames > 1 and frames - 1 = (select count(*) from link l where l.patch_id = chain.patch_id and l.frame_id // 3 = chain.gof_id)""")
def union_patch_size(pc: DataFrame) -> DataFrame:
    boxes = _moved(pc)
    links = matching.candidates(boxes, 3, 0.3).filter("patch_id = previous_id")
    return matching.unions(links, boxes, 3)


@query(f"{SORTED} select frame_id, ppi, w, h, 1 as matched from box where ppi < 3 union all select frame_id, ppi, w, h, 0 from box where ppi >= 3")
def matched_then_unmatched(pc: DataFrame) -> DataFrame:
    box = _boxes(pc).select(*PATCH, "w", "h")
    return box.filter("ppi < 3").withColumn("matched", F.lit(1)).unionByName(box.filter("ppi >= 3").withColumn("matched", F.lit(0)))


PLACED = f"{AXES}, put as (select frame_id, ppi, min(u) as min_u, min(v) as min_v, max(v) - min(v) + 1 as h, (ppi % 3) * 64 as pos_x, (ppi // 3) * 64 as pos_y, ppi % 2 = 1 as swapped from pix group by all), onmap as (select p.frame_id, p.ppi, p.pt_idx, p.r, p.g, p.b, p.u, p.v, pos_x + case when swapped then p.v - min_v else p.u - min_u end as x, pos_y + case when swapped then p.u - min_u else p.v - min_v end as y from pix p join put q on p.frame_id = q.frame_id and p.ppi = q.ppi)"


def _placement(pc: DataFrame) -> DataFrame:
    box = patches.bounding_boxes(patches.projected(pc), PATCH)
    return box.select(*PATCH, "min_u", "min_v", (F.col("max_v") - F.col("min_v") + 1).alias("h"), ((F.col("ppi") % 3) * 64).alias("pos_x"), (F.expr("ppi div 3") * 64).alias("pos_y"), (F.col("ppi") % 2 == 1).alias("swapped"))


def _on_map(pc: DataFrame) -> DataFrame:
    pixels = patches.projected(pc).select(*PATCH, "pt_idx", "u", "v")
    return maps.on_map(pixels, _placement(pc), PATCH)


@query(f"{PLACED} select frame_id, ppi, x::bigint as x, y::bigint as y, r, g, b from onmap")
def patch_to_map(pc: DataFrame) -> DataFrame:
    return maps.coloured(_on_map(pc), pc, "pt_idx").select("frame_id", "ppi", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "r", "g", "b")


BLOCKS = f"""{PLACED}, blocks as (select frame_id, x // 4 as bx, y // 4 as "by", count(*) as filled, count(*) >= 2 as occupied from (select distinct frame_id, x, y from onmap) group by all)"""


@query(f"{BLOCKS} select * from blocks")
def om_downscale(pc: DataFrame) -> DataFrame:
    return maps.occupancy_blocks(_on_map(pc), 4, 2)


@query(f"""{BLOCKS}, few as (select frame_id, bx, "by" from blocks where filled >= 9) select o.frame_id, count(*) as pixels from onmap o join few f on o.frame_id = f.frame_id and o.x // 4 = f.bx and o.y // 4 = f."by" group by all""")
def om_zeroed(pc: DataFrame) -> DataFrame:
    pixels = _on_map(pc)
    return maps.kept_pixels(pixels, maps.occupancy_blocks(pixels, 4, 9), 4).groupBy("frame_id").agg(F.count("*").alias("pixels"))


@query(f"{BLOCKS} select frame_id, bx // 2 as BX, \"by\" // 2 as BY, max(occupied) as \"any\", sum(case when occupied then filled else 0 end)::bigint as pixels from blocks group by frame_id, bx // 2, \"by\" // 2")
def om_large_blocks(pc: DataFrame) -> DataFrame:
    return maps.any_occupied(maps.occupancy_blocks(_on_map(pc), 4, 2), 2)


@query(f"{PLACED} select (frame_id // 3)::bigint as gof_id, ((greatest(max(pos_y + h), 16) + 7)::int & -8)::int as height from put group by all")
def om_height(pc: DataFrame) -> DataFrame:
    return maps.heights(_placement(pc), 3, 16).withColumn("gof_id", F.col("gof_id").cast("long"))


GRID = f"""{AXES}, grid as (select f.frame_id, f.ppi, bx, "by", max(pix.d) as val from (select distinct frame_id, ppi from pc) f cross join range(0, 16) a(bx) cross join range(0, 16) b("by") left join pix on pix.frame_id = f.frame_id and pix.ppi = f.ppi and pix.u // 4 = bx and pix.v // 4 = "by" group by all)"""


@query(f"""{GRID}, s as (select *, case when bx = 0 then last_value(val ignore nulls) over (partition by frame_id, ppi, bx order by "by" rows unbounded preceding) else val end as v0 from grid) select frame_id, ppi, bx::int as bx, "by"::int as "by", coalesce(last_value(v0 ignore nulls) over (partition by frame_id, ppi, "by" order by bx rows unbounded preceding), -1) as val from s""")
def bg_fill_rows(pc: DataFrame) -> DataFrame:
    cells = patches.projected(pc).groupBy(*PATCH, F.expr("u div 4").cast("int").alias("bx"), F.expr("v div 4").cast("int").alias("by")).agg(F.max("d").alias("val"))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(15))).alias(n)
    grid = pc.select(*PATCH).distinct().select(*PATCH, axis("bx")).select(*PATCH, "bx", axis("by"))
    return maps.fill_from_left(grid.join(cells, [*PATCH, "bx", "by"], "left"), "val", tuple(PATCH)).fillna(-1, ["val"])


@query("select distinct r, g, b, trunc(0.2126::float * r::float + 0.7152::float * g::float + 0.0722::float * b::float)::int as luma from pc")
def rgb_to_yuv_luma(pc: DataFrame) -> DataFrame:
    return pc.select("r", "g", "b", maps.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma")).distinct()


@query("""with q as (select frame_id, x // 2 as cx, y // 2 as cy, count(*) as n, 0.25::float * sum(r)::float as r, 0.25::float * sum(g)::float as g, 0.25::float * sum(b)::float as b from (select frame_id, x, y, min(r) as r, min(g) as g, min(b) as b from pc group by all) group by all having count(*) = 4)
select frame_id, cx, cy, trunc(-0.114572::float * r + -0.385428::float * g + 0.5::float * b + 128::float)::int as cb, trunc(0.5::float * r + -0.454153::float * g + -0.045847::float * b + 128::float)::int as cr from q""")
def rgb_to_yuv_chroma(pc: DataFrame) -> DataFrame:
    return maps.chroma(pc.groupBy("frame_id", "x", "y").agg(*(F.min(c).alias(c) for c in "rgb")))


@query(f"{AXES}, s as (select distinct frame_id, ppi, u, v from pix) select distinct s.frame_id, s.ppi, s.u, s.v from s, (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b) where not exists (select 1 from s t where t.frame_id = s.frame_id and t.ppi = s.ppi and t.u = s.u + a and t.v = s.v + b)")
def patch_borders(pc: DataFrame) -> DataFrame:
    return maps.borders(patches.projected(pc), PATCH)


@query("""with s as (select frame_id, 0 as axis, x as level, y as a, z as b, pt_idx from pc union all select frame_id, 1, y, x, z, pt_idx from pc union all select frame_id, 2, z, y, x, pt_idx from pc)
select *, row_number() over (partition by frame_id, axis, level order by a, b, pt_idx) - 1 as place from s""")
def slice_levels(pc: DataFrame) -> DataFrame:
    return slices.levels(pc)


VOTES = "with w as (select frame_id, pt_idx, case when r % 3 > 0 then r % 6 end as vx, case when g % 4 > 0 then g % 6 end as vy, case when b % 5 > 0 then b % 6 end as vz from pc)"


def _votes(pc: DataFrame) -> DataFrame:
    return pc.select("frame_id", "pt_idx", *(F.when(F.col(c) % m > 0, F.col(c) % 6).alias(v) for c, m, v in (("r", 3, "vx"), ("g", 4, "vy"), ("b", 5, "vz"))))


@query(f"{VOTES} select frame_id, pt_idx, case when vx = vy then vx when vx = vz then vx when vy = vz then vy when vx is not null and vy is not null and vz is not null then vy else -1 end as ppi, coalesce(vx = vy or vx = vz or vy = vz, false) as normal from w")
def axis_vote(pc: DataFrame) -> DataFrame:
    v = [F.col(c) for c in ("vx", "vy", "vz")]
    return _votes(pc).select("frame_id", "pt_idx", F.coalesce(slices.voted(*v), F.lit(-1)).alias("ppi"), slices.has_normal(*v).alias("normal"))


PARENTS = "with c as (select frame_id, pt_idx, case when pt_idx % 4 = 0 then ppi end as ppi, case when pt_idx % 2 = 0 then pt_idx // 2 end as parent_x, case when pt_idx % 3 = 0 then pt_idx // 3 end as parent_y, pt_idx // 4 as parent_z from pc)"


@query(f"{PARENTS} select c.frame_id, c.pt_idx, coalesce(c.ppi, y.ppi, x.ppi, z.ppi, -1) as ppi from c left join c x on x.frame_id = c.frame_id and x.pt_idx = c.parent_x left join c y on y.frame_id = c.frame_id and y.pt_idx = c.parent_y left join c z on z.frame_id = c.frame_id and z.pt_idx = c.parent_z")
def child_inherit(pc: DataFrame) -> DataFrame:
    i = F.col("pt_idx")
    rows = pc.select("frame_id", "pt_idx", F.when(i % 4 == 0, F.col("ppi")).alias("ppi"), F.when(i % 2 == 0, F.expr("pt_idx div 2").cast("int")).alias("parent_x"), F.when(i % 3 == 0, F.expr("pt_idx div 3").cast("int")).alias("parent_y"), F.expr("pt_idx div 4").cast("int").alias("parent_z"))
    return slices.inherited(rows).select("frame_id", "pt_idx", F.coalesce("ppi", F.lit(-1)).alias("ppi"))


@query("""with g as (select frame_id, pt_idx, case when pt_idx % 7 in (0, 1) then ppi end as v from pc), m as (select *, last_value(v ignore nulls) over l as lv, first_value(v ignore nulls) over r as rv, last_value(case when v is not null then pt_idx end ignore nulls) over l as lp, first_value(case when v is not null then pt_idx end ignore nulls) over r as rp from g
 window l as (partition by frame_id order by pt_idx rows unbounded preceding), r as (partition by frame_id order by pt_idx rows between current row and unbounded following))
select frame_id, pt_idx, case when lv is null then rv when rv is null or pt_idx - lp <= (rp - lp - 1) // 2 + 1 then lv else rv end as v from m""")
def gap_fill(pc: DataFrame) -> DataFrame:
    rows = pc.select("frame_id", "pt_idx", F.when((F.col("pt_idx") % 7).isin(0, 1), F.col("ppi")).alias("v"))
    return slices.gaps_filled(rows, ["frame_id"], "pt_idx", "v")
