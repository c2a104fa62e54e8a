"""Connected components of an edge table, without ever holding all edges in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


class UnionFind:
    """Of any hashable items; the root of a set is its smallest item."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest node of each of its own components, for so many edges at a time."""

    def stars(sets: UnionFind) -> pa.RecordBatch:
        nodes = np.fromiter(sets.up, np.int64, len(sets.up))
        roots = np.array([sets.find(int(x)) for x in nodes], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots], pa.int64()), pa.array(roots[nodes != roots], pa.int64())], names=["u", "v"])

    sets = UnionFind()
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            sets.join(u, v)
        if len(sets.up) > 2 * TASK_EDGES:
            yield stars(sets)
            sets = UnionFind()
    yield stars(sets)


#: Edges that one task contracts at a time; a node with more edges than HOT, and than a thousandth of all, is joined apart.
TASK_EDGES, HOT = 250_000, 100_000


def _least_at(edges: DataFrame, on: str, least: DataFrame, total: int) -> DataFrame:
    """edges with m of least(node, m) at their end `on`; the edges of a hub stay where they are, only its m comes to them."""
    hot = [r[0] for r in edges.groupBy(on).count().filter(F.col("count") > max(HOT, total // 1000)).select(on).collect()] if total > HOT else []  # a thousand at most
    own = edges.filter(~F.col(on).isin(hot)) if hot else edges
    out = own.join(least.withColumnRenamed("node", on), on, "left").select("u", "v", "m")
    if hot:  # a thousand rows at most are broadcast
        few = least.filter(F.col("node").isin(hot)).withColumnRenamed("node", on)
        out = out.unionByName(edges.filter(F.col(on).isin(hot)).join(F.broadcast(few), on, "left").select("u", "v", "m"))
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges(u, v) reaches; nodes without an edge don't occur.

    Tasks contract what edges they hold to stars; where one task holds all that is left, that is the result. Else large-star
    and small-star follow in turns, until a round changes nothing; edges shrink to one star a component.
    """
    now = cut_lineage(edges.select("u", "v"))
    tasks = max(1, -(-now.count() // TASK_EDGES))
    now = now.coalesce(tasks).mapInArrow(contract, "u long, v long")
    now = cut_lineage(now if tasks == 1 else now.distinct())
    before, total = None, now.count() if tasks > 1 else 0
    while total:
        # now: u > v. Large star: u moves from v to the smallest neighbour of v.
        smallest = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = cut_lineage(_least_at(now, "v", smallest, total).select("u", F.coalesce("m", "v").alias("v")).distinct())
        # Small star: u and its smaller neighbours move to the smallest of them.
        smallest = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        joined = _least_at(large, "u", smallest, total)
        now = cut_lineage(joined.select("u", F.col("m").alias("v")).union(joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, total = state, state[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
