"""PLY files as a Spark data source, and as a sink."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# PLY's scalar types as numpy's.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ALIASES = {"x": ("x",), "y": ("y",), "z": ("z",), "r": ("red", "r"), "g": ("green", "g"), "b": ("blue", "b")}


def parse(data: bytes) -> dict[str, np.ndarray]:
    """Columns of the vertex element; lists in it are skipped. Formats: ascii, binary_little_endian, binary_big_endian."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    body = data.find(b"\n", end) + 1
    kind, elements = None, []
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], TYPES[words[1]], None) if words[1] != "list" else (words[-1], TYPES[words[3]], TYPES[words[2]]))
    if all(name != "vertex" for name, _, _ in elements):
        raise ValueError("no vertex element")
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(kind)
    lines = iter(data[body:].split(b"\n")) if kind == "ascii" else None
    at = body
    for name, count, properties in elements:
        plain = all(size is None for _, _, size in properties)
        if order and plain:
            kinds = np.dtype([(p, order + t) for p, t, _ in properties])
            rows = np.frombuffer(data, kinds, count, at)
            at += kinds.itemsize * count
            columns = {p: rows[p] for p, _, _ in properties}
        else:
            columns = {p: [] for p, _, size in properties if size is None}
            for _ in range(count):
                words = iter(next(lines).split()) if lines is not None else None
                for p, t, size in properties:
                    if words is not None:
                        own = [next(words) for _ in range(int(next(words)))] if size else [next(words)]
                    else:
                        n = 1
                        if size:
                            n = int(np.frombuffer(data, order + size, 1, at)[0])
                            at += np.dtype(size).itemsize
                        own = np.frombuffer(data, order + t, n, at)
                        at += np.dtype(t).itemsize * n
                    if not size:
                        columns[p].append(own[0])
            columns = {p: np.array(columns[p], dtype=t) for p, t, size in properties if size is None}
        if name == "vertex":
            return columns
    raise ValueError("no vertex element")


def cloud_of(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z as 16-bit and r, g, b as 8-bit unsigned values."""
    columns, out = parse(data), {}
    for name, aliases in ALIASES.items():
        found = next((columns[a] for a in aliases if a in columns), None)
        if found is None:
            raise ValueError(f"the vertex element has no {' or '.join(aliases)}")
        out[name] = found.astype(np.int64).astype(np.uint16 if name in "xyz" else np.uint8).astype(np.int32)
    return out


def number(path: str) -> Column:
    """The digits before `.ply`, else 0; a folder of that name counts as a file."""
    return F.coalesce(F.regexp_extract(path, r"([0-9]+)\.ply(?:/[^/]*)?$", 1).try_cast("int"), F.lit(0))


def read(spark: SparkSession, paths: str | list[str], depth: int | None = None) -> DataFrame:
    """points(frame_id, pt_idx, x, y, z, r, g, b): a frame for each file, numbered by the digits before `.ply`.

    Spark lists and reads the files, wherever they are; a task decodes whole files. With depth, points with a
    coordinate of 2 ** depth or more are dropped.
    """
    import pyarrow as pa

    def decode(batches):
        for b in batches:
            for frame, content in zip(b.column("frame_id").to_pylist(), b.column("content").to_pylist()):
                c = cloud_of(content)
                n = len(c["x"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(c[k]) for k in "xyzrgb")], names=["frame_id", "pt_idx", *"xyzrgb"])

    files = spark.read.format("binaryFile").load(paths).select(number("path").alias("frame_id"), "content")
    points = files.mapInArrow(decode, "frame_id int, pt_idx int, x int, y int, z int, r int, g int, b int")
    return points if depth is None else points.filter(" and ".join(f"shiftright({c}, {depth}) = 0" for c in "xyz"))


# The properties of a written vertex, with the type of each; normals only where points have them.
WRITTEN = (("x", "ushort", "%d"), ("y", "ushort", "%d"), ("z", "ushort", "%d"), ("r", "uchar red", "%d"), ("g", "uchar green", "%d"), ("b", "uchar blue", "%d"), ("nx", "float", "%.6f"), ("ny", "float", "%.6f"), ("nz", "float", "%.6f"))


def lines(points: DataFrame) -> DataFrame:
    """(frame_id, value): each frame as the text of an ASCII PLY file; a frame is put together in one task.

    Points with nx, ny, nz are written with their normals.
    """
    written = [w for w in WRITTEN if w[0] in points.columns]
    row = F.format_string(" ".join(f for *_, f in written), *(name for name, *_ in written))
    bodies = points.groupBy("frame_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pt_idx", row.alias("line")))).alias("rows"))
    properties = "".join(f"property {kind if ' ' in kind else f'{kind} {name}'}\n" for name, kind, _ in written)
    head = F.format_string(f"ply\nformat ascii 1.0\nelement vertex %d\n{properties}end_header\n", "n")
    return bodies.select("frame_id", F.concat(head, F.array_join(F.col("rows.line"), "\n"), F.lit("\n")).alias("value"))


def _files(points: DataFrame) -> DataFrame:
    """lines() for a text sink, which adds the last line's end."""
    return lines(points).withColumn("value", F.expr("left(value, char_length(value) - 1)"))


def write(points: DataFrame, folder: str) -> None:
    """One ASCII PLY file a frame, in folders frame_id=N."""
    _files(points).write.partitionBy("frame_id").mode("overwrite").text(folder)


def write_numbered(points: DataFrame, folder: str, prefix: str = "frame_") -> str:
    """One ASCII PLY file a frame, each in a folder that is named like a file; the pattern of their names."""
    named = _files(points).select(F.format_string(f"{prefix}%04d.ply", "frame_id").alias("file"), "value")
    named.write.partitionBy("file").mode("overwrite").text(folder)
    return f"{folder}/file={prefix}%04d.ply"
