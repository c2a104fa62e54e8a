"""Queries for what streams, sinks and files do, over tables that come from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import frame_stream, ply, scratch, v3c_file
from ..streaming import gof
from ..streaming.sink import GroupTable
from . import derived, pipeline
from .kernels import PARAMETERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def ended(writer, spark: SparkSession) -> None:
    """Runs a stream up to its end."""
    writer.option("checkpointLocation", scratch.shared(spark, "state")).trigger(availableNow=True).start().awaitTermination()


@query("select user_id % 5 as stream, user_id // 5 // 4 as gof_id, array_to_string(list_sort(list(distinct user_id // 5)), ',') as frames, count(distinct user_id // 5) = 4 as complete from events group by all")
def grouped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the events table as frames of five sequences that come in no order: groups of four, the short ones when the stream is at its end."""
    frames = F.expr("user_id div 5")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 5).cast("string").alias("sequence"), frames.alias("frame_id")).distinct()
    sizes = events.groupBy("sequence", F.expr("frame_id div 4").alias("gof_id")).agg(F.count("*").cast("int").alias("of_group"))
    place = scratch.shared(spark, "frames")
    events.withColumn("gof_id", F.expr("frame_id div 4")).join(sizes, ["sequence", "gof_id"]).write.parquet(place)
    stream = spark.readStream.schema(spark.read.parquet(place).schema).parquet(place)
    out = scratch.shared(spark, "groups")
    ended(gof.each_group(gof.grouped_frames(stream, 4, idle_ms=None), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")), spark)
    groups = spark.read.parquet(out)
    return groups.select(F.col("sequence").cast("long").alias("stream"), "gof_id", F.array_join("frames", ",").alias("frames"), (F.size("frames") == 4).alias("complete"))


@query(f"with {derived.oracle(False)} select frame_id // 3 as gof_id, count(distinct frame_id) as frames, 5 as units, 0 as unequal from pc group by all")
def streamed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cloud as numbered files, streamed and encoded group by group: as many groups, and the same units, as in one batch."""
    points, p = derived.cloud(spark, sf_dir), PARAMETERS.changed(least_points=5)
    pattern = ply.write_numbered(points, scratch.shared(spark, "clouds"))
    table = GroupTable(spark, scratch.shared(spark, "coded"))
    frames = points.agg(F.max("frame_id")).first()[0]
    ended(gof.encode_frames(spark, pattern, p, table.out, frames=0 if frames is None else frames + 1), spark)
    batch = pipeline.all_units(pipeline.encode(points, p), p).select("gof_id", "unit_seq", F.sha2("payload", 256).alias("want"))
    both = table.units().select("gof_id", "unit_seq", F.sha2("payload", 256).alias("got")).join(batch, ["gof_id", "unit_seq"], "full")
    compared = both.groupBy("gof_id").agg(F.count("got").cast("int").alias("units"), F.count_if(~F.col("got").eqNullSafe(F.col("want"))).cast("int").alias("unequal"))
    return table.committed().select("gof_id", F.col("frames").cast("long").alias("frames")).join(compared, "gof_id", "full")


V3C_FILE = """
with u as (select conv_id as gof_id, turn as unit_seq, encode(coalesce(text, '')) as payload, row_number() over (order by conv_id, turn, octet_length(encode(coalesce(text, ''))), md5(coalesce(text, ''))) as place, coalesce(text, '') as text from conversations)
select gof_id, unit_seq, octet_length(payload)::bigint as size, (1 + sum(octet_length(payload) + 5) over (order by place) - octet_length(payload))::bigint as at, md5(text) as digest from u
"""


@query(V3C_FILE)
def v3c_file_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a unit of one file that tasks write in parallel; each is read back from its place in the file."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("gof_id"), F.col("turn").alias("unit_seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    path, folder = scratch.shared(spark, "file"), scratch.shared(spark, "index")
    v3c_file.write(turns, path)
    index = v3c_file.places(v3c_file.staged(turns, folder), folder)
    return v3c_file.read_units(index, path).select("gof_id", "unit_seq", "size", "at", F.md5("payload").alias("digest"))
