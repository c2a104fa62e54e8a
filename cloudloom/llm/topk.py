"""Exact top-k inner products by a dual-tree search over cover trees.

The upper level of the tree is common to queries and data: pivots fitted on a bounded sample; every vector lies under its
nearest pivot, and each pivot knows its covering radius. Under a pivot, data are dealt into chunks of a bounded number of
rows. A first pass searches one chunk of each query's own pivot for a worst kth score to start with; a pivot whose centre
and covering radius cannot beat it is pruned for that query. In the second pass each remaining chunk builds a cover tree over
its data, the queries that visit it come past in blocks with trees of their own, and both trees are walked together: a
pair of nodes is pruned when the bound from their centres and covering radii stays below the worst kth score of the
whole query node. A node's children are centred on vectors more than half its radius apart; where more than FANOUT would be
needed to cover it at half its radius, children keep the radius that they have. Results are merged by query.

Scores are integers: components become floor(scale * x), as longs. Edge cases: vectors that are null, empty or hold null or
non-finite components take no part; vectors meet only those of equal length; ties go to the smaller id; with fewer
candidates than k all are returned; rows that repeat an id are queries and candidates each, and only a query's own row is
none of its candidates (`query_row` tells such queries apart); components and scores beyond a long are held at its
limits; null ids take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Bounds: vectors that the pivots are fitted on, pivots of a vector length, data rows of a chunk, queries of a block, vectors of
#: a leaf, children of a node.
SAMPLE, PIVOTS, CHUNK, BLOCK, LEAF, FANOUT = 4096, 32, 16384, 4096, 512, 8
LONG = 2**63 - 1


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, dim, v) of the vectors that take part; v is an array of longs, row a number of the row."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    longs = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), longs.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column (all of one length) as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats where no sum can leave their exact range, else in integers, held at a long's limits."""
    most = (float(np.abs(q.astype(float)).max(initial=0)) + 1) * (float(np.abs(x.astype(float)).max(initial=0)) + 1) * q.shape[1]
    if most < 2.0**53:
        kind = np.float32 if most < 2.0**24 else np.float64
        return q.astype(kind) @ x.T.astype(kind)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = lambda v: np.array([[int(c) for c in row] for row in v], object)
    return np.clip(whole(q) @ whole(x).T, -LONG, LONG).astype(np.int64)


def just_below(scores: np.ndarray) -> np.ndarray:
    """scores as doubles, lowered where a double may stand above the score it is for."""
    out = scores.astype(float)
    return np.where(np.abs(out) < 2.0**53, out, out - np.abs(out) * 1e-15)


@dataclass
class Node:
    """A cover-tree node: a centre, the radius that covers all its vectors, and children or the rows of a leaf."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list["Node"]
    norm: float = 0.0
    best: list[np.ndarray] = field(default_factory=list)  # of a leaf of queries: query, score and id of the best so far

    def __post_init__(self) -> None:
        self.norm = float(np.linalg.norm(self.centre))


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, leaf: int | None = None) -> Node:
    """The tree of the vectors x (doubles): children are centred on vectors more than half their parent's radius apart."""
    rows, leaf = np.arange(len(x)) if rows is None else rows, leaf or LEAF
    own = x[rows]
    centre = own[np.argmin(((own - own.mean(0)) ** 2).sum(1))]
    distance = np.sqrt(((own - centre) ** 2).sum(1))
    node = Node(centre, float(distance.max(initial=0)), rows, [])
    if len(rows) <= leaf or node.radius == 0:
        if len(rows) > leaf:  # equal vectors: any cut will do
            node.children = [Node(centre, 0.0, rows[i : i + leaf], []) for i in range(0, len(rows), leaf)]
        return node
    centres, near, parent = [centre], distance, np.zeros(len(rows), int)
    while len(centres) < FANOUT and near.max() > node.radius / 2:
        centres.append(own[int(near.argmax())])
        d = np.sqrt(((own - centres[-1]) ** 2).sum(1))
        closer = d < near
        parent[closer], near[closer] = len(centres) - 1, d[closer]
    if np.bincount(parent).max() > 0.9 * len(rows):  # one dense part: cut it in two by the distance from the centre
        parent = (np.argsort(np.argsort(distance, kind="stable"), kind="stable") >= len(rows) // 2).astype(int)
    node.children = [cover_tree(x, rows[parent == j], leaf) for j in range(parent.max() + 1) if (parent == j).any()]
    return node


def bound(q: Node, x: Node) -> float:
    """No inner product of a vector under q with one under x is larger; a little more than that, for rounding."""
    most = (q.norm + q.radius) * (x.norm + x.radius)
    return float(q.centre @ x.centre) + most - q.norm * x.norm + 1e-9 * (1 + most)


class Search:
    """A block of queries in one chunk: the best k of each query so far, and a floor below which nothing is looked for."""

    def __init__(self, q: np.ndarray, q_rows: np.ndarray, floors: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, k: int):
        self.q, self.q_rows, self.x, self.x_rows, self.x_ids, self.k = q, q_rows, x, x_rows, x_ids, k
        self.worst = floors.copy()  # a score below this cannot be among the best k; an equal one can
        self.leaves: dict[int, Node] = {}

    def base(self, qn: Node, xn: Node) -> None:
        """All products of two leaves, those that may be among the best k merged with the best so far."""
        s, k = products(self.q[qn.rows], self.x[xn.rows]), self.k
        good = s >= self.worst[qn.rows][:, None]
        many = np.flatnonzero(good.sum(1) > k + 1)
        if len(many):  # only each row's best k and one more (its own), and what equals the last of them
            good[many] &= s[many] >= np.partition(s[many], -(k + 1), axis=1)[:, -(k + 1)][:, None]
        a, b = np.nonzero(good)
        if not len(a):
            return
        scores = s[a, b].astype(np.int64)
        a, b = qn.rows[a], xn.rows[b]
        use = self.q_rows[a] != self.x_rows[b]
        new = [a[use], scores[use], self.x_ids[b[use]]]
        query, score, id_ = (np.concatenate(c) for c in zip(qn.best, new)) if qn.best else new
        order = np.lexsort((id_, -score, query))
        query, score, id_ = query[order], score[order], id_[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        top = rank < k
        qn.best = [query[top], score[top], id_[top]]
        last = rank == k - 1
        self.worst[query[last]] = np.maximum(self.worst[query[last]], just_below(score[last]))
        self.leaves[id(qn)] = qn

    def visit(self, qn: Node, xn: Node) -> None:
        if bound(qn, xn) < self.worst[qn.rows].min():
            return
        if not qn.children and not xn.children:
            self.base(qn, xn)
        elif not qn.children or xn.children and xn.radius >= qn.radius:
            for child in sorted(xn.children, key=lambda c: -bound(qn, c)):
                self.visit(qn, child)
        else:
            for child in qn.children:
                self.visit(child, xn)


FOUND = "query_row long, query_id long, id long, score long"


def _searched(k: int):
    """Searches chunks in rows sorted by chunk, a chunk's data before its queries; holds one chunk and a block of queries."""
    schema = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "id", "score")])

    def search(data: list[pa.RecordBatch], tree: Node, x: tuple[np.ndarray, ...], queries: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(queries), BLOCK):
            block = queries.slice(at, BLOCK).combine_chunks()
            q, rows, ids = matrix(block.column("v").combine_chunks()), block.column("row").to_numpy(), block.column("id").to_numpy()
            run = Search(q, rows, just_below(block.column("floor").to_numpy()), *x, k)
            run.visit(cover_tree(q.astype(float)), tree)
            for leaf in run.leaves.values():
                query, score, id_ = leaf.best
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[query], ids[query], id_, score)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data, tree, x, waiting = None, [], None, None, []

        def asked() -> Iterator[pa.RecordBatch]:
            nonlocal tree, x, waiting
            if data and waiting:
                if tree is None:
                    t = pa.Table.from_batches(data)
                    v = matrix(t.column("v").combine_chunks())
                    tree, x = cover_tree(v.astype(float)), (v, t.column("row").to_numpy(), t.column("id").to_numpy())
                yield from search(data, tree, x, pa.Table.from_batches(waiting))
            waiting = []

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("dim", "pivot", "chunk", "asks")]) if b.num_rows else np.zeros((4, 0))
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for a, z in zip(edges, edges[1:]):
                own, part = tuple(keys[:3, a].tolist()), b.slice(a, z - a)
                if own != key:
                    yield from asked()
                    key, data, tree = own, [], None
                if keys[3, a]:
                    waiting.append(part)
                    if sum(w.num_rows for w in waiting) >= BLOCK:
                        yield from asked()
                else:
                    data.append(part)
        yield from asked()

    return work


def pivots(data: DataFrame, count: int = PIVOTS, sample: int = SAMPLE, rounds: int = 8) -> dict[int, np.ndarray]:
    """Centres of the common upper level for each vector length in a bounded sample, by k-means; other lengths have the origin."""
    by: dict[int, list] = {}
    for r in data.orderBy(F.xxhash64("id", "row"), "row").limit(sample).collect():
        by.setdefault(r["dim"], []).append(r["v"])
    out: dict[int, np.ndarray] = {}
    for dim, rows in by.items():
        x = np.array(rows, float)
        c = x[:: max(1, len(x) // count)][:count].copy()
        for _ in range(rounds):
            own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = x[own == j].mean(0)
        out[dim] = np.unique(c, axis=0)
    return out


def placed(data: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """data with its pivot and its distance from it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            pivot, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = matrix(b.column("v").take(pa.array(at))).astype(float)
                c = centres.get(int(dim), np.zeros((1, x.shape[1])))
                pivot[at] = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
                far[at] = np.sqrt(((x - c[pivot[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(far)], names=["row", "id", "dim", "v", "pivot", "far"])

    return data.mapInArrow(place, "row long, id long, dim int, v array<long>, pivot int, far double")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_row, query_id, rank, id, score): the k rows with the largest inner product of each row for which is_query holds.

    is_query is a condition on column `id`.
    """
    data = cut_lineage(quantised(rows, id_col, vector_col, scale))
    centres = pivots(data)
    data = placed(data, centres)
    data = cut_lineage(data)
    under = data.groupBy("dim", "pivot").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # at most PIVOTS a length
    if not under:
        return data.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    tops = {(r["dim"], r["pivot"]): (centres[r["dim"]][r["pivot"]] if r["dim"] in centres else np.zeros(r["dim"]), r["radius"], -(-r["n"] // CHUNK)) for r in under}
    parts = data.sparkSession.createDataFrame([(*key, n) for key, (_, _, n) in tops.items()], "dim int, pivot int, parts int")
    data = data.join(F.broadcast(parts), ["dim", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    cols = ["dim", "pivot", "chunk", "row", "id", "v"]
    data, queries = data.select(cols), data.filter(is_query).select(cols)
    order = ["dim", "pivot", "chunk", "asks"]

    def met(asked: DataFrame) -> DataFrame:
        both = data.withColumns({"floor": F.lit(0.0), "asks": F.lit(0)}).unionByName(asked.withColumn("asks", F.lit(1)))
        return both.repartition("dim", "pivot", "chunk").sortWithinPartitions(order).mapInArrow(_searched(k), FOUND)

    # first pass: each query in the chunk of its own row, for a worst kth score to start with
    seeds = cut_lineage(met(queries.withColumn("floor", F.lit(float("-inf")))))
    floors = seeds.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    queries = queries.join(floors, "row", "left").select("dim", F.col("pivot").alias("home"), F.col("chunk").alias("room"), "row", "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other chunk under a pivot that its bound doesn't prune."""
        for b in batches:
            dims, floor, home, room = (b.column(c).to_numpy() for c in ("dim", "floor", "home", "room"))
            for (dim, pivot), (centre, radius, chunks) in tops.items():
                at = np.flatnonzero(dims == dim)
                if not len(at):
                    continue
                q = matrix(b.column("v").take(pa.array(at))).astype(float)
                norm = np.linalg.norm(q, axis=1)
                most = q @ centre + radius * norm + 1e-9 * (1 + norm * (np.linalg.norm(centre) + radius))
                at = at[most >= just_below(floor[at])]
                for chunk in range(chunks):
                    own = at[(home[at] != pivot) | (room[at] != chunk)]
                    if len(own):
                        got = b.take(pa.array(own))
                        fixed = [pa.array(np.full(len(own), x, np.int32)) for x in (dim, pivot, chunk)]
                        yield pa.RecordBatch.from_arrays([*fixed, *(got.column(c) for c in ("row", "id", "v", "floor"))], names=[*cols, "floor"])

    found = met(queries.mapInArrow(spread, "dim int, pivot int, chunk int, row long, id long, v array<long>, floor double"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id")  # k rows of each chunk at most
    ranked = seeds.unionByName(found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "id", "score")
