"""Streams of frames in groups of a fixed count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import Parameters
from ..plans import pipeline
from ..sources import frame_stream, ply
from .sink import GroupTable

GROUP = "sequence string, gof_id long, frames array<long>, paths array<string>, complete boolean"


def grouped_frames(frames: DataFrame, size: int, frame: str = "frame_id", idle_ms: int | None = 10_000) -> DataFrame:
    """(sequence, gof_id, frames, paths, complete) of a stream of frames: a group is given out when its frames are all there.

    A group has `size` frames, or as many as its column of_group tells (a row without a frame may tell it too). A group that
    stays short is given out after idle_ms without news; with idle_ms None nothing is waited for. Frames of different
    `sequence`s (one, if there is no such column) are grouped apart. A frame that comes after its group was given
    out begins a new group of that number, which GroupTable sets aside.
    """

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, expected = {}, size
        if state.exists:
            numbers, paths, expected = state.get
            held = dict(zip(numbers, paths))

        def out(complete: bool) -> pd.DataFrame:
            if state.exists:
                state.remove()
            numbers = sorted(held)
            return pd.DataFrame({"sequence": [key[0]], "gof_id": [key[1]], "frames": [numbers], "paths": [[held[n] for n in numbers]], "complete": [complete]})

        if state.hasTimedOut:
            yield out(False)
            return
        for b in batches:
            expected = min(expected, int(b["of_group"].min()))
            own = b[b["frame"].notna()]
            held |= dict(zip(own["frame"].astype(int).tolist(), own["path"].tolist()))
        if len(held) >= expected:
            yield out(True)
        else:
            numbers = sorted(held)
            state.update((numbers, [held[n] for n in numbers], expected))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)

    has = set(frames.columns)
    gof = F.col("gof_id") if "gof_id" in has else F.expr(f"{frame} div {size}")
    keyed = frames.select(
        F.coalesce(F.col("sequence"), F.lit("")).alias("sequence") if "sequence" in has else F.lit("").alias("sequence"),
        gof.cast("long").alias("gof_id"),
        F.col(frame).cast("long").alias("frame"),
        (F.col("path") if "path" in has else F.lit(None).cast("string")).alias("path"),
        (F.coalesce(F.col("of_group"), F.lit(size)) if "of_group" in has else F.lit(size)).cast("int").alias("of_group"),
    )
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return keyed.groupBy("sequence", "gof_id").applyInPandasWithState(collect, GROUP, "frames array<long>, paths array<string>, expected int", "append", timeout)


def limited(spark: SparkSession, folder: str, schema: str, files: int, form: str = "binaryFile") -> DataFrame:
    """A stream of the files of a folder, at most so many a batch: with one batch a second, that many frames a second at most.

    A batch begins when the one before it is done, so a slow consumer holds the source back.
    """
    reader = spark.readStream.format(form).option("maxFilesPerTrigger", files)
    return reader.schema(schema).load(folder)


def _encoded(spark: SparkSession, p: Parameters, groups: list[Row], take: Callable[[DataFrame], None]) -> None:
    """Hands the units of whole groups of one sequence to take; frames are read by the paths that come with them (at most p.in_flight, or one group)."""
    numbered = spark.createDataFrame([(n, path) for g in groups for n, path in zip(g["frames"], g["paths"])], "own int, path string")
    places = numbered.groupBy(ply.number("path").alias("frame_id")).agg(F.collect_list("own").alias("own"))  # a file can be several frames of a loop
    points = ply.read(spark, sorted({path for g in groups for path in g["paths"]}), p.input_depth)
    points = points.join(F.broadcast(places), "frame_id").withColumn("frame_id", F.explode("own")).drop("own")
    tables = pipeline.encode(points, p)
    take(pipeline.all_units(tables, p))
    pipeline.release(tables)


def _groups_into(stream: DataFrame, p: Parameters, out: str, seconds: float):
    spark = stream.sparkSession
    table = GroupTable(spark, out)

    def work(batch: DataFrame, i: int) -> None:
        table.add(batch.collect(), i, lambda _, groups, take: _encoded(spark, p, groups, take), p.in_flight)  # a row a group

    return each_group(stream, work, seconds)


def encode_frames(spark: SparkSession, pattern: str, p: Parameters, out: str, fps: float | None = None, **options: object):
    """A writer that encodes numbered PLY files in their order into the GroupTable `out`: see frame_stream for the options.

    At most p.in_flight frames are encoded at once. fps: frames taken up a second at most. With frames= or end= the last short group is
    given out at once; start the writer with .trigger(availableNow=True) to stop at the end.
    """
    if fps:
        options["limit"] = max(1, round(fps))
    stream = frame_stream.frames(spark, pattern, size=p.gof_size, **options)
    return _groups_into(grouped_frames(stream, p.gof_size, idle_ms=None), p, out, options["limit"] / fps if fps else 1.0)


def encode_stream(spark: SparkSession, folder: str, p: Parameters, out: str, files: int = 64, seconds: float = 1.0, idle_ms: int = 10_000):
    """A writer that encodes PLY files as they come into a folder, in any order, into the GroupTable `out`.

    At most `files` files are taken up a batch; a group is encoded when all its frames are there, the last one of a stream after
    idle_ms without news. Files are named by what precedes their frame's number, which is their sequence.
    """
    seen = limited(spark, folder, "path string, modificationTime timestamp, length long, content binary", files)
    seen = seen.select(ply.number("path").alias("frame_id"), "path", F.regexp_extract("path", r"([^/]*?)[0-9]+\.ply(?:/[^/]*)?$", 1).alias("sequence"))
    return _groups_into(grouped_frames(seen, p.gof_size, idle_ms=idle_ms), p, out, seconds)


def each_group(stream: DataFrame, work: Callable[[DataFrame, int], None], seconds: float = 1.0):
    """A writer that hands every batch of complete groups to work(batch, batch id), in order, one at a time."""
    ordered = lambda batch, i: work(batch.orderBy("gof_id"), i)
    return stream.writeStream.outputMode("append").foreachBatch(ordered).trigger(processingTime=f"{seconds} seconds")
