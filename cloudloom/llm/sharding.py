"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one global order (digest of the text, then id, then place in the input), which keeps equal texts side by
side and spreads a hot group, of equal rows too, over as many range partitions as its rows need. Each partition reports its total bytes and rows; the driver
turns those totals (three numbers a partition) into prefix sums; every row then knows its global byte position, and
the shards are cut at equal byte targets.

Edge cases: a null text counts as empty (1 byte); null ids sort first; repeated rows take neighbouring places;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: A cut moves to the edge of the group of equal texts that it would split if that shifts it by no more than this
#: share of a shard's bytes (or by one document of the largest size); a larger group is split.
SLACK = 0.02


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, digest) in the global order, as a checkpoint with fixed partitions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.md5(F.encode(text, "UTF-8")).alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["digest", "id", "place"]
    return cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place"))


def positions(rows: DataFrame, starts: dict[int, tuple[int, int]]) -> DataFrame:
    """rows with their global byte position and row number, from the prefix sums of the partitions."""
    schema = "id long, size long, crc long, digest string, at long, row long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at, row = starts[b.column("part")[0].as_py()]
            size = b.column("size").to_numpy()
            ends = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("id", "size", "crc", "digest")] + [pa.array(ends - size), pa.array(np.arange(row, row + len(size)))],
                names=["id", "size", "crc", "digest", "at", "row"],
            )
            at, row = int(ends[-1]), row + len(size)

    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(place, schema)


def cuts(placed: DataFrame, total: int, largest: int, shards: int, slack: float) -> list[tuple[int, int]]:
    """(byte, row) where shards 1, 2, ... begin: the edge next to each equal target, of a group if near enough."""
    targets = [total * i // shards for i in range(1, shards)]
    near = F.exists(F.array([F.lit(t) for t in targets]), lambda t: (F.col("at") <= t) & (t < F.col("at") + F.col("size")))
    hit = placed.filter(near).select("at", "size", "row", "digest").collect()  # at most one row a target
    groups = {
        r["digest"]: r
        for r in placed.filter(F.col("digest").isin(list({r["digest"] for r in hit})))
        .groupBy("digest")
        .agg(F.min("at").alias("b0"), F.max(F.col("at") + F.col("size")).alias("b1"), F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"))
        .collect()
    }
    allowed, out = max(slack * total / shards, largest), []
    for t in targets:
        r = next(r for r in hit if r["at"] <= t < r["at"] + r["size"])
        g = groups[r["digest"]]
        edges = [(g["b0"], g["r0"]), (g["b1"], g["r1"])]
        best = min(edges, key=lambda e: (abs(e[0] - t), e[0]))
        if abs(best[0] - t) > allowed:
            best = min([(r["at"], r["row"]), (r["at"] + r["size"], r["row"] + 1)], key=lambda e: (abs(e[0] - t), e[0]))
        out.append(best)
    return out


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """(id, size, crc, digest, shard, slot) of every row: contiguous in the global order, nearly equal in bytes."""
    rows = ordered(docs, id_col, text_col)
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most")).orderBy("part").collect()
    bytes_before, rows_before = ([0, *accumulate(r[c] for r in parts)] for c in ("bytes", "n"))
    starts = {r["part"]: (b, n) for r, b, n in zip(parts, bytes_before, rows_before)}
    placed = positions(rows, starts)
    if not parts:
        return placed.select("id", "size", "crc", "digest", F.lit(0).alias("shard"), F.col("row").alias("slot"))
    edges = cuts(placed, bytes_before[-1], max(r["most"] for r in parts), shards, slack)
    at_row = [0, *(r for _, r in edges)]
    shard = sum((F.col("row") >= r).cast("int") for r in at_row[1:]) if shards > 1 else F.lit(0)
    first = F.element_at(F.array([F.lit(at_row[bisect_right(at_row, r) - 1]).cast("long") for r in at_row]), shard + 1)
    return placed.select("id", "size", "crc", "digest", shard.cast("int").alias("shard"), (F.col("row") - first).alias("slot"))
