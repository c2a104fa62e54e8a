"""Command line: PLY frames to a coded file."""

from __future__ import annotations

import argparse
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import frames
from .params import Parameters, resolve
from .plans import pipeline
from .sources import ply, sdp, sinks
from .sources.frame_stream import present
from .streaming import gof
from .streaming.sink import GroupTable

VERSION = "0.2"


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="cloudloom", description=__doc__)
    a.add_argument("-i", "--input", required=True, help="folder, glob, or pattern like seq_vox10_%%04d.ply")
    a.add_argument("-o", "--output", required=True, help="coded file")
    a.add_argument("-n", "--frames", type=int, help="frames to read; of a pattern that tells none, all that follow")
    a.add_argument("-s", "--start-frame", type=int, help="number of the first file of a pattern")
    a.add_argument("-l", "--loop-input", type=int, default=1, help="times that the frames are read; 0: endlessly, with --stream")
    a.add_argument("-f", "--input-fps-limiter", type=int, default=0, help="frames taken up a second at most, with --stream; 0: no limit")
    a.add_argument("--stream", action="store_true", help="read the pattern as a stream, group by group; the output is a folder of groups")
    a.add_argument("--end-mark", help="with --stream and no number of frames: a file whose presence says that no frame follows")
    a.add_argument("-g", "--geo-precision", type=int, help="bits of a coordinate; else what the name tells")
    a.add_argument("-t", "--threads", type=int, default=0, help="local threads, 0 for all")
    a.add_argument("-d", "--dummy-run", type=int, nargs="?", const=1, default=0, help="resolve the parameters, print them and stop")
    a.add_argument("-p", "--preset", choices=("fast", "slow"), default="fast")
    a.add_argument("-m", "--mode", choices=("AI", "RA"), default="RA")
    a.add_argument("-r", "--rate", help="like 16-22-2")
    a.add_argument("--set", default="", help="parameters as name=value,name=value")
    a.add_argument("--statistics", help="folder for a JSON line a frame")
    a.add_argument("--sdp-outdir", help="folder for session descriptions")
    a.add_argument("--dst-address", help="address that the session descriptions name")
    a.add_argument("--dst-port", type=int, default=8890, help="first port that the session descriptions name")
    a.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    return a


def numbers(spark: SparkSession, args: argparse.Namespace) -> tuple[int, int]:
    """(first file, files) as asked, else as the pattern tells; 0 files if nothing tells."""
    told = spark.range(1).select(frames.from_name(F.lit(args.input)).alias("x")).first()["x"]
    return told["start"] if args.start_frame is None else args.start_frame, args.frames or told["frames"]


def stream(spark: SparkSession, args: argparse.Namespace, p: Parameters) -> None:
    """Encodes a pattern's files as a stream into the folder args.output, up to its end; started again, it goes on where it was."""
    start, count = numbers(spark, args)
    if not count and not args.end_mark:
        raise SystemExit("the pattern tells no number of frames: give --frames or --end-mark")
    options = {"start": start, "frames": count or None, "loops": args.loop_input if count else None, "end": args.end_mark}
    writer = gof.encode_frames(spark, args.input, p, args.output, fps=args.input_fps_limiter or None, **options)
    endless = args.loop_input == 0 or args.input_fps_limiter or not count
    writer = writer.option("checkpointLocation", f"{args.output}/checkpoint")
    query = (writer if endless else writer.trigger(availableNow=True)).start()
    if args.loop_input == 0 or not endless:
        query.awaitTermination()
        return
    idle = 0  # seconds: a stream that is started again at its end has nothing to tell
    while query.isActive and not over(query.lastProgress) and idle < 30:
        query.awaitTermination(1)
        status = query.status
        known = count or present(args.end_mark)
        idle = idle + 1 if known and not status["isTriggerActive"] and not status["isDataAvailable"] else 0
    query.stop()
    print(f"{GroupTable(spark, args.output).committed().count()} groups")


def over(progress: dict | None) -> bool:
    """Whether the source of a stream was at its end when its last batch was done."""
    return progress is not None and any(re.search(r"ended\W+true", str(s["endOffset"]), re.I) for s in progress["sources"])


def read(spark: SparkSession, args: argparse.Namespace, depth: int):
    """Points of all frames; of a pattern its files in turn, as often as asked."""
    if "%" not in args.input:
        points = ply.read(spark, args.input, depth)
        first = args.start_frame or 0
        points = points.filter(F.col("frame_id") >= first).withColumn("frame_id", F.col("frame_id") - first)
        return points if args.frames is None else points.filter(F.col("frame_id") < args.frames)
    start, count = numbers(spark, args)
    if args.loop_input == 0:
        raise SystemExit("an endless loop needs --stream")
    if not count:
        raise SystemExit("the pattern tells no number of frames: give --frames")
    paths = [r["path"] for r in frames.paths(spark, args.input, start, count).orderBy("frame_id").collect()]
    points = ply.read(spark, paths, depth).withColumn("frame_id", F.col("frame_id") - start)
    loops = spark.range(args.loop_input).select((F.col("id") * count).cast("int").alias("later"))
    return points.join(F.broadcast(loops)).withColumn("frame_id", F.col("frame_id") + F.col("later")).drop("later") if args.loop_input > 1 else points


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    name = os.path.basename(args.input)
    told = int(name.split("vox", 1)[1][:2].rstrip("_")) if "vox" in name and name.split("vox", 1)[1][:1].isdigit() else 10
    depth = args.geo_precision or told
    p = resolve(depth, args.preset, args.mode, args.rate, args.set)
    if args.dummy_run:
        print(p)
        return
    spark = SparkSession.builder.appName("cloudloom").master(f"local[{args.threads or '*'}]").getOrCreate() if args.threads else SparkSession.builder.appName("cloudloom").getOrCreate()
    if args.stream:
        stream(spark, args, p)
        return
    tables = pipeline.encode(read(spark, args, depth), p)
    units = pipeline.all_units(tables, p)
    pipeline.write_file(units, args.output)
    if args.statistics:
        sinks.write_statistics(pipeline.statistics(tables, p), args.statistics)
    if args.sdp_outdir:
        os.makedirs(args.sdp_outdir, exist_ok=True)
        for r in sdp.descriptions(units, args.dst_port, args.dst_address).collect():
            with open(os.path.join(args.sdp_outdir, r["name"]), "w") as f:
                f.write(r["text"])
    pipeline.release(tables)


if __name__ == "__main__":
    main()
