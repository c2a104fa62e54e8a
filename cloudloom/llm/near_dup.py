"""MinHash near-duplicates with an LSH forest, links confirmed on full shingle sets.

Every text becomes the set of its k-word shingles (64-bit hashes), a fingerprint of that set and a MinHash signature.
Texts with equal sets collapse into one class first, so a group of exact copies of any size is one row from there on.
The forest holds each class's signature in several orders (trees). In each tree, classes that share a prefix of the
order are neighbours; a crowded region is sorted by the rest of the order, and only the neighbours with the longest
common prefixes meet, in windows: the depth adapts to the region. Classes of crowded regions get more trees, of longer
orders. Pairs whose signatures and sizes allow the threshold (less four standard errors) connect candidates.

A candidate component small enough for one task is settled there on full sets, all pairs at once. A larger one is dealt
into blocks: each is settled together with some texts that all blocks share, and what that links makes one group of most
texts; only the others are held against all texts, block by block. So a hot group's texts are read once or twice, and no pair
that could link two groups is left out. Candidates are not exact: of a region of more than WINDOW classes only
neighbours within a window are compared, so a link is lost where its two texts are further apart in all trees and no
other candidates connect them.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; with fewer than k words the whole
sequence is the only shingle; a null id has no component and is kept; rows that repeat an id are judged each on its own
text, and all rows of the smallest id are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, cut_lineage, lean, mix, shingles, small_batches, spans, text_chunks, word_hashes, written
from .components import connected, contract

LANES, TREES, DEPTH = 96, 16, 3
MORE_TREES = 32  # trees that classes of crowded regions get besides
WINDOW = 2048  # neighbours that meet in a crowded region
SMALL_DOCS, SMALL_SHINGLES = 250, 1_000_000  # a candidate component, or two of its blocks, that one task settles
SHARED = 32  # texts that all blocks of a large component share, about
_U = np.uint64


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, sorted distinct shingles of all rows, where each row's begin and end)."""
    for first, last, data, offsets in text_chunks(column):
        starts, stops, words_of = spans(data, offsets)
        hashes, where = shingles(word_hashes(data, starts, stops), words_of, k)
        own = []
        for a, b in zip(where[:-1], where[1:]):
            s = np.sort(hashes[a:b])
            own.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b - a > 1 else s)
        sizes = np.array([len(s) for s in own], np.int64)
        yield first, last, np.concatenate(own), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, where: np.ndarray, lanes_: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of two words, the first lanes_ 16-bit minima of the signatures, sizes) of each set; zeros where it is empty."""
    n, full = len(where) - 1, np.flatnonzero(np.diff(where))
    prints, lanes = np.zeros((n, 2), np.uint64), np.zeros((n, LANES), np.uint16)
    if len(full):
        starts, masks, factors = where[full], constants(LANES, 11), constants(LANES, 13)
        with np.errstate(over="ignore"):
            prints[full, 0] = np.add.reduceat(mix(sets), starts)
            prints[full, 1] = np.bitwise_xor.reduceat(mix(sets ^ _U(0x5851F42D4C957F2D)), starts)
            for j in range(lanes_):
                lanes[full, j] = np.minimum.reduceat((sets ^ masks[j]) * factors[j], starts) >> _U(48)
    return prints, lanes, np.diff(where)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def sign(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, print, sig) of every row."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, sets, where in shingle_sets(b.column(1), k):
                prints, lanes, n = signatures(sets, where)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(n, pa.int64()), _binary(prints), _binary(lanes)], names=["id", "n", "print", "sig"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, "id long, n long, print binary, sig binary")


def orders(more: bool = False) -> np.ndarray:
    """The order of all lanes in each tree; the first trees begin with lanes of their own, further ones with any."""
    step = LANES // TREES
    if not more:
        return np.array([np.roll(np.arange(LANES), -t * step) for t in range(TREES)])
    random = np.random.default_rng(19)
    return np.array([random.permutation(LANES) for _ in range(MORE_TREES)])


def _planted(classes: DataFrame, more: bool) -> DataFrame:
    """(bucket, cls) of each class in each tree, a bucket for equal first DEPTH lanes."""

    @lean
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, trees = constants(DEPTH + 2, 17), orders(more)
        for b in batches:
            if not b.num_rows:
                continue
            lanes = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, LANES)
            for t, order in enumerate(trees):
                first = lanes[:, order[:DEPTH]].astype(np.uint64)
                with np.errstate(over="ignore"):
                    keys = mix(((first + _U(1)) * factors[:DEPTH]).sum(1) + factors[DEPTH + more] * _U(t + 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), t, np.int32)), b.column("cls")], names=["bucket", "tree", "cls"])

    return classes.select("cls", "sig").mapInArrow(plant, "bucket long, tree int, cls long")


def forest(classes: DataFrame, more: bool = False) -> DataFrame:
    """(bucket, tree, cls, n, sig) of the classes that share the first DEPTH lanes of some tree with another one."""
    keyed = _planted(classes, more)
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    return keyed.join(shared, "bucket").join(classes.select("cls", "n", "sig"), "cls").select("bucket", "tree", "cls", "n", "sig")


def in_order(rows: DataFrame, more: bool = False) -> DataFrame:
    """Forest rows in signature order: by bucket, then by the rest of the tree's own order of the lanes."""
    trees = F.array(*(F.array(*(F.lit(int(x)) for x in order[DEPTH:])) for order in orders(more)))
    lane = lambda j: F.substring("sig", 2 * j + 1, 2)
    if more:
        rest = F.concat(*(lane(F.get(F.get(trees, F.col("tree")), F.lit(j))) for j in range(32)))  # more lanes than families share
    else:
        rest = F.expr(f"substring(concat(sig, sig), tree * {2 * (LANES // TREES)} + {2 * DEPTH + 1}, {LANES})")
    return rows.withColumn("rest", rest).repartitionByRange("bucket", "rest", "cls").sortWithinPartitions("bucket", "rest", "cls")


def regions(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("bucket", "cls", "n")) -> Iterator[dict[str, np.ndarray]]:
    """Windows of neighbours: the rows of one bucket, or overlapping runs of a crowded one."""

    def decode(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        out = {c: t.column(c).to_numpy() for c in columns}
        return out | {"sig": np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, LANES)}

    held: dict[str, np.ndarray] | None = None
    for b in batches:
        for at in range(0, b.num_rows, 4 * WINDOW):
            new = decode([b.slice(at, 4 * WINDOW)])
            if held is not None:
                new = {c: np.concatenate([held[c], new[c]]) for c in new}
            cuts = np.flatnonzero(np.diff(new["bucket"])) + 1
            edges = [0, *cuts.tolist()]
            for a, z in zip(edges, edges[1:]):
                yield from _windows({c: x[a:z] for c, x in new.items()})
            held = {c: x[edges[-1] :] for c, x in new.items()}
            while len(held["bucket"]) > 2 * WINDOW:  # a crowded region: its first window is full, the next overlaps it
                yield {c: x[:WINDOW] for c, x in held.items()}
                held = {c: x[WINDOW // 2 :] for c, x in held.items()}
    if held is not None:
        yield from _windows(held)


def _windows(region: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    n = len(region["bucket"])
    for at in range(0, max(1, n - WINDOW // 2), WINDOW // 2) if n > WINDOW else (0,):
        if min(n, at + WINDOW) - at > 1:
            yield {c: x[at : at + WINDOW] for c, x in region.items()}


def agreeing(sig: np.ndarray) -> np.ndarray:
    """Lanes in which each pair of signatures agrees."""
    m = len(sig)
    if m <= 48:
        return (sig[:, None, :] == sig[None, :, :]).sum(2)
    out = np.zeros((m, m), np.uint8)
    for j in range(LANES):
        out += sig[:, None, j] == sig[None, :, j]
    return out


def allowed(region: dict[str, np.ndarray], num: int, den: int) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose signatures don't speak against it."""
    t = num / den
    least = math.floor(LANES * t - 4 * math.sqrt(LANES * t * (1 - t)))
    n = region["n"]
    sizes = den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])
    out = (agreeing(region["sig"]) >= least) & sizes
    np.fill_diagonal(out, False)
    return out


def _reach(adjacent: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a window reaches."""
    label = np.arange(len(adjacent))
    while True:
        least = np.concatenate([np.where(adjacent[i : i + 256], label[None, :], len(label)).min(1) for i in range(0, len(label), 256)])
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def candidates(rows: DataFrame, num: int, den: int, more: bool = False) -> DataFrame:
    """Edges (u, v) that connect what the windows hold for possible links: stars, so never more than rows.

    A class that lies in a crowded region has an edge to itself besides.
    """

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    @lean
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded: list[np.ndarray] = []

        def stars() -> Iterator[pa.RecordBatch]:
            for region in regions(batches):
                cls, label = region["cls"], _reach(allowed(region, num, den))
                moved = label != np.arange(len(label))
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(cls[moved]), pa.array(cls[label[moved]])], schema=schema)
                if len(label) == WINDOW:  # a full window is one of a crowded region
                    crowded.append(cls)

        for edges in contract(stars()):
            yield edges
            if crowded:
                own = pa.array(np.unique(np.concatenate(crowded)))
                crowded.clear()
                yield pa.RecordBatch.from_arrays([own, own], schema=schema)

    return in_order(rows, more).select("bucket", "cls", "n", "sig").mapInArrow(link, "u long, v long")


def linked_in(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The smallest row that each of some sets reaches over links, from the exact sizes of all intersections."""
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if den * both >= num * (n.sum() - both) else 1])
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)
    shared = np.full((m, m), (counts == m).sum(), np.float32)
    some = (counts > 1) & (counts < m)
    slot = np.cumsum(some) - 1
    use = some[where]
    at, row = slot[where[use]], row[use]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    width = 4096
    for first in range(0, int(some.sum()), width):
        a, b = np.searchsorted(at, [first, first + width])
        block = np.zeros((m, width), np.float32)
        block[row[a:b], at[a:b] - first] = 1
        shared += block @ block.T
    adjacent = np.zeros((m, m), bool)
    for i in range(0, m, 256):
        both = shared[i : i + 256].astype(np.int64)
        adjacent[i : i + 256] = den * both >= num * (n[i : i + 256, None] + n[None, :] - both)
    np.fill_diagonal(adjacent, False)
    return _reach(adjacent)


def _settle(num: int, den: int):
    def settle(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_numpy()
        _, one = np.unique(cls, return_index=True)  # a shared text may come twice
        cls, own = cls[one], table.column("shingles").take(pa.array(one)).to_pylist()
        label = linked_in([np.frombuffer(x, np.uint64) for x in own], num, den) if len(one) > 1 else np.zeros(1, np.int64)
        return pa.table({"u": pa.array(cls), "v": pa.array(cls[label])}).filter(pa.array(label != np.arange(len(label))))

    return settle


EDGES = "u long, v long"


def _settled(rows: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Edges (u, v) within each group of rows(keys, cls, shingles); groups of like size are dealt evenly, in the order of their keys."""
    settle = _settle(num, den)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            own = np.stack([b.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0).any(0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if held and key != tuple(own[:, a].tolist()):
                    yield from settle(pa.Table.from_batches(held)).to_batches()
                    held = []
                key = tuple(own[:, a].tolist())
                held.append(b.slice(a, z - a))
        if held:
            yield from settle(pa.Table.from_batches(held)).to_batches()

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, EDGES)


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(cls, shingles) of the texts of ids(rep, cls, print): one document's of each class."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, sets, where in shingle_sets(b.column("text"), k):
                same = _binary(signatures(sets, where, 0)[0]).to_pylist()
                mine = [x == y for x, y in zip(same, b.column("print").slice(first, last - first).to_pylist())]
                own = [sets[a:z].tobytes() for a, z in zip(where[:-1], where[1:])]
                yield pa.RecordBatch.from_arrays([b.column("cls").slice(first, last - first), pa.array(own, pa.binary())], names=["cls", "shingles"]).filter(pa.array(mine))

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    named = texts.join(ids.select("rep", "cls", "print"), "rep").select("cls", "print", "text")
    return named.mapInArrow(work, "cls long, shingles binary").dropDuplicates(["cls"])


def _in_blocks(sets: DataFrame, crowds: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) that connect what is linked in candidate components too large for one task: crowds(cls, component, blocks, size).

    First every block is settled with the component's shared texts, which links the blocks' groups. Then all texts
    outside a component's largest group so far are held against all of it, one block of either in a task.
    """
    met = written(sets.join(crowds, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))), "crowds")
    shared = met.filter(F.pmod(F.xxhash64("cls", F.lit(1)), F.col("size")) < SHARED)
    spread = shared.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["component", "block", "cls", "shingles"]
    first = cut_lineage(_settled(met.select(columns).unionByName(spread.select(columns)), columns[:2], num, den))
    label = connected(first).withColumnRenamed("component", "label")
    labelled = cut_lineage(met.select("cls", "component").join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "component", F.coalesce("label", "cls").alias("label")))
    groups = labelled.groupBy("component", "label").agg(F.count("*").alias("c"))
    largest = groups.groupBy("component").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    largest = cut_lineage(largest.select("component", "main", F.ceil(F.col("others") / SMALL_DOCS * 2).alias("rooms")))
    if largest.isEmpty():
        return first
    again = met.join(F.broadcast(largest), "component") if largest.count() <= 10_000 else met.join(largest, "component")
    outside = again.join(labelled.select("cls", "label"), "cls").filter("label != main").withColumn("room", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("rooms")))
    here = again.withColumn("room", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1)))
    outside = outside.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["component", "block", "room", "cls", "shingles"]
    return first.unionByName(_settled(here.select(columns).unionByName(outside.select(columns)), columns[:3], num, den))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n, component) of every row: links where den * |A & B| >= num * |A | B|, components by the smallest id."""
    signed = written(sign(docs, id_col, text_col, k), "signatures")
    own = signed.filter("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(own.withColumn("cls", F.xxhash64("print")), "classes")
    edges = cut_lineage(candidates(written(forest(classes), "forest"), num, den))
    crowded = edges.filter("u = v").select(F.col("u").alias("cls"))
    edges = edges.filter("u != v")
    if not crowded.isEmpty():
        rows = written(forest(classes.join(crowded, "cls", "left_semi"), True), "forest")
        edges = edges.unionByName(candidates(rows, num, den, True).filter("u != v"))
    near = connected(edges)
    near = cut_lineage(near.join(classes.select(F.col("cls").alias("node"), "rep", "print", "n"), "node"))
    crowd = F.greatest(F.ceil(F.count("*") / SMALL_DOCS), F.ceil(F.sum("n") / SMALL_SHINGLES))  # 1: one task settles it
    sizes = near.groupBy("component").agg(crowd.alias("crowd"), F.count("*").alias("size")).select("component", "size", F.when(F.col("crowd") > 1, 2 * F.col("crowd")).otherwise(1).alias("blocks"))
    placed = cut_lineage(near.join(sizes, "component").select(F.col("node").alias("cls"), "rep", "print", "component", "blocks", "size"))
    sets = written(sets_of(docs, placed, id_col, text_col, k), "shingles")
    final = sets.join(placed.filter("blocks = 1"), "cls").select("component", "cls", "shingles").groupBy("component").applyInArrow(_settle(num, den), EDGES)
    if not placed.filter("blocks > 1").isEmpty():
        final = final.unionByName(_in_blocks(sets, placed.filter("blocks > 1").select("cls", "component", "blocks", "size"), num, den))
    linked = connected(final).select(F.col("node").alias("cls"), F.col("component").alias("group"))
    linked = cut_lineage(linked.join(classes.select("cls", "rep"), "cls"))
    named = cut_lineage(linked.join(linked.groupBy("group").agg(F.min("rep").alias("component")), "group").select("cls", "component"))
    wide = classes.select("cls", "print", "rep", "c").join(named, "cls", "left").filter((F.col("c") > 1) | F.col("component").isNotNull()).select("print", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "print").join(wide, "print", "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"))
