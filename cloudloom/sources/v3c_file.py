"""Coded units as one file, without any of them passing the driver.

Units are staged as a table first. A file is one header byte, then every unit behind its length in five bytes. Where a unit begins follows from the lengths alone: their
prefix sums, from the totals of ranges of units (one small row each) and running sums within a range. Ranges are dealt by bytes, so a
task writes about PART_BYTES whatever the units' sizes. On a file system that all tasks can open and seek in, every task writes its
range at its place of the one file, which gets its name when all is there. Elsewhere each range is a part, written through Arrow's file
systems under a name that follows from its number, so that a task that runs again replaces what it wrote; the file is the parts in the
order of their names, and a store that can join files by name (concat) does so without moving a byte.

Edge cases: no units give a file of the header byte; a null payload is an empty unit; units of equal (gof_id, unit_seq) follow one another
in the order of their payloads' lengths and digests.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.container import FILE_PRECISION, file_bytes
from . import scratch

#: Bytes that a task writes, about; the last unit of a range may go beyond.
PART_BYTES = 64 << 20
ORDER = ("gof_id", "unit_seq")


def staged(units: DataFrame, folder: str) -> DataFrame:
    """units as a table in a folder, with a number, length and digest of each row: what made them runs once."""
    payload = F.coalesce("payload", F.lit(b""))
    rows = units.select(*ORDER, payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.md5(payload).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return scratch.written(rows, f"{folder}/units")


def places(table: DataFrame, folder: str, ranges: int | None = None) -> DataFrame:
    """(row, gof_id, unit_seq, size, at) of staged units: the payload's bytes and where they begin in the file. Reads lengths only."""
    n = ranges or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.select("row", *ORDER, "size", "digest").repartitionByRange(n, *ORDER, "size", "digest", "row").withColumn("range", F.spark_partition_id())
    order = Window.partitionBy("range").orderBy(*ORDER, "size", "digest", "row")
    upto = F.sum(F.col("size") + FILE_PRECISION).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = scratch.written(ranged.withColumn("upto", upto), f"{folder}/lengths")  # ranges are drawn once
    totals = inside.groupBy("range").agg(F.max("upto").alias("total"))  # a row a range
    before = F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = totals.select("range", (before + 1).alias("begin"))
    return inside.join(F.broadcast(begins), "range").select("row", *ORDER, "size", (F.col("begin") + F.col("upto") - F.col("size")).alias("at"))


def pieces(units: DataFrame, folder: str, part_bytes: int | None = None) -> DataFrame:
    """(part, at, bytes): every unit's bytes with its length before them and where they go; `at` of the header is 0."""
    table = staged(units, folder)
    where = places(table, folder).select("row", (F.col("at") - FILE_PRECISION).alias("at"))
    length = F.unhex(F.lpad(F.hex("size"), 2 * FILE_PRECISION, "0"))
    rows = table.join(where, "row").select("at", F.concat(length, "payload").alias("bytes"))
    header = units.sparkSession.createDataFrame([(0, file_bytes([]))], "at long, bytes binary")
    return header.unionByName(rows).select(F.expr(f"at div {part_bytes or PART_BYTES}").alias("part"), "at", "bytes")


def in_place(path: str) -> bool:
    """Whether tasks can open and seek in a file at a path."""
    return path.startswith("file:///") or "://" not in path


def write(units: DataFrame, path: str, part_bytes: int | None = None) -> int:
    """The file at a path; its bytes. Paths without a scheme and file: ones are written in place, others by write_parts and a join."""
    if not in_place(path):
        parts = f"{path}.parts-{uuid.uuid4().hex}"
        size = write_parts(units, parts, part_bytes)
        join_parts(units.sparkSession, parts, path)
        return size
    folder, local = scratch.shared(units.sparkSession, "file"), path.removeprefix("file://")
    aside = f"{local}.{uuid.uuid4().hex}.tmp"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        fd = os.open(aside, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for b in batches:
                for at, data in zip(b.column(0).to_pylist(), b.column(1)):
                    view = memoryview(data.as_buffer())
                    while len(view):
                        done = os.pwrite(fd, view, at)
                        view, at, written = view[done:], at + done, written + done
            os.fsync(fd)
        finally:
            os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    rows = pieces(units, folder, part_bytes).repartition("part").select("at", "bytes")
    size = rows.mapInArrow(work, "written long").agg(F.sum("written")).first()[0]
    if os.path.getsize(aside) != size:
        raise OSError(f"{aside}: {os.path.getsize(aside)} bytes for {size}; tasks must share the file system of {path}")
    os.replace(aside, local)
    scratch.remove(units.sparkSession, folder)
    return size


def write_parts(units: DataFrame, folder: str, part_bytes: int | None = None) -> int:
    """The file in parts part-00000000.., whose concatenation in the order of their names is the file; its bytes."""
    from pyarrow import fs

    def store() -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, base), out, now, written = store(), None, None, 0
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                if part != now:
                    if out is not None:
                        out.close()
                    out, now = files.open_output_stream(f"{base}/part-{part:08d}"), part
                out.write(data.as_buffer())
                written += len(data.as_buffer())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    files, base = store()
    files.create_dir(base, recursive=True)
    scratch_folder = scratch.shared(units.sparkSession, "file")
    rows = pieces(units, scratch_folder, part_bytes).repartition("part").sortWithinPartitions("part", "at").select("part", "bytes")
    size = rows.mapInArrow(work, "written long").agg(F.sum("written")).first()[0]
    scratch.remove(units.sparkSession, scratch_folder)
    return size


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file from the parts of a folder, by the store's own concat (by name, no byte is moved); an error where the store has none."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(folder)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
    rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names) - 1)
    for i, name in enumerate(names[1:]):
        rest[i] = jvm.org.apache.hadoop.fs.Path(name)
    if len(names) > 1:
        fs.concat(jvm.org.apache.hadoop.fs.Path(names[0]), rest)
    fs.rename(jvm.org.apache.hadoop.fs.Path(names[0]), jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(source, True)


def read_units(index: DataFrame, path: str, at: str = "at", size: str = "size") -> DataFrame:
    """index with the payload that the file at a path holds at each row's place: the length before it must be the one that the index tells.

    A task opens the file and reads its rows' places only (a file system that all tasks can open).
    """
    local = path.removeprefix("file://")
    columns = index.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(local, "rb") as f:
            for b in batches:
                out = []
                for begin, n in zip(b.column(at).to_pylist(), b.column(size).to_pylist()):
                    f.seek(begin - FILE_PRECISION)
                    told = int.from_bytes(f.read(FILE_PRECISION), "big")
                    if told != n:
                        raise ValueError(f"{path}: {told} bytes at {begin}, not {n}")
                    out.append(f.read(n))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*columns, "payload"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInArrow(work, f"{fields}, payload binary")
