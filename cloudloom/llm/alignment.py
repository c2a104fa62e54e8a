"""Alignment of two tokenizers over the same texts: overlaps, groups, linked tokens and how often ids are linked.

A text is a blank and its words as A and as B see them; tokens are ranges of its bytes. The B tokens of a text are a static interval index
(their starts and ends, sorted as they stand); two bisections stab it with each A token and give the run of B tokens that it
overlaps. A gap between two B tokens that no A token spans is the border of a group. Links are the pairs of such a run
that end together. Both tokenizers are run once a text: what they give is written to a table in the shared folder, with
each document's different linked pairs and their counts, and everything corpus-wide is counted from that table.

Pair counts are at most as many as pairs of ids. Where there are at most IN_MEMORY, every task gets all of them as sorted
arrays; beyond, only the pairs of HOT and more documents (at most IN_MEMORY of them) travel so, and the rest are joined by pair.

Edge cases: texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens: zeros and an empty
string of groups; repeated ids and null ids are rows of their own; an empty table gives an empty result; other columns
are ignored. A text of any length is aligned whole, by one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_chunks, written

#: Pair counts that every task may hold (24 bytes each); different pairs that a task counts before it hands them on.
IN_MEMORY, COUNTED = 2_000_000, 1_000_000
#: Bytes of text that are aligned at once (a longer text alone).
CHUNK = 500_000
SHIFT = 32  # a pair as one long: A's id above, B's below
# The pattern that a byte-level tokenizer splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BASE = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ROWS = BASE + ", a array<int>, b array<int>, times array<int>"


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids and token bytes of a byte-level BPE file. Special tokens inside a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        definition = json.loads(self.tokenizer.to_str())
        letters = byte_level()
        special = {t["content"] for t in definition["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in definition["model"]["vocab"].items() if t not in special}
        self.ranked = None
        if definition["normalizer"] is None and is_plain(definition["pre_tokenizer"]) and not definition["model"].get("dropout"):
            self.ranked = self.by_rank(definition["model"])

    def by_rank(self, model: dict) -> object | None:
        """A faster encoder of the same ids, if the ids follow the order of merges.

        It merges any two neighbours whose bytes are a token, the file's own only listed pairs. Both agree on every text if every token's bytes
        encode to that token (tests): a piece of a text that becomes one token goes through the same merges as alone.
        """
        import tiktoken

        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))) or any(vocab.get(c, 256) > 255 for c in byte_level()):
            return None
        return tiktoken.Encoding("ranks of the file", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def is_plain(split: dict | None) -> bool:
    return bool(split) and split["type"] == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]


class Pieces:
    """Ids and token bytes of a sentence-piece model, which puts a blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for i, p in enumerate(names)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@dataclass
class Side:
    """A tokenizer with its tokens' bytes as one buffer, and its ids in decimal followed by each of two marks."""

    of: ByteLevel | Pieces
    marks: str

    def __post_init__(self) -> None:
        n = 1 + max(self.of.bytes)
        self.tokens = [self.of.bytes.get(i, b"") for i in range(n)]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.names = [str(i).encode() + m.encode() for m in self.marks for i in range(n)]

    def encode(self, texts: list[str], whole: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of each text, and whether they join to its bytes."""
        ids = self.of.encode(texts)
        return ids, np.array([b"".join(map(self.tokens.__getitem__, i)) == w for i, w in zip(ids, whole)], bool)


_sides: dict[tuple[str, str], Side] = {}


def side(path: str, marks: str) -> Side:
    """The worker process's own, kept from task to task."""
    if (path, marks) not in _sides:
        _sides[path, marks] = Side(tokenizer(path), marks)
    return _sides[path, marks]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run [first, last) of B tokens that each A token overlaps. Tokens have a byte at least and cover the same bytes."""
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


def borders(first: np.ndarray, last: np.ndarray, n_b: int) -> np.ndarray:
    """Whether the gap after each B token is spanned by no A token (the one after the last never is)."""
    steps = np.zeros(n_b + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last - 1, -1)
    return np.cumsum(steps[:n_b]) == 0


def aligned(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A token of each link, B token of each link)."""
    first, last = overlaps(a_ends, b_ends)
    closed = borders(first, last, len(b))
    group_b = np.append(0, np.cumsum(closed)[:-1]) if len(b) else np.zeros(0, np.int64)
    together = np.flatnonzero(b_ends[last - 1] == a_ends) if len(a) else np.zeros(0, np.int64)
    return group_b[first] if len(a) else group_b, group_b, together, (last - 1)[together]


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights=times, minlength=len(found)).astype(np.int64)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times) of every document, as a table in the shared folder.

    a, b, times: the document's different linked id pairs and how often it links them.
    """

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = side(path_a, ",|"), side(path_b, ",;")
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1), CHUNK):
                yield one_chunk(left, right, batch.column(0)[first:last], data.tobytes(), offsets)

    cut = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, ROWS)
    return written(cut.select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")


def one_chunk(left: Side, right: Side, ids: pa.Array, raw: bytes, offsets: np.ndarray) -> pa.RecordBatch:
    """The rows of one chunk's texts; all tokens lie behind one another, so that each step is one for the whole chunk."""
    n = len(ids)
    spoken = np.flatnonzero(np.diff(offsets))
    own = [raw[offsets[d] : offsets[d + 1]] for d in spoken]
    texts, whole = [t.decode() for t in own], [b" " + t for t in own]
    (a, fits_a), (b, fits_b) = left.encode(texts, whole), right.encode(texts, whole)
    good = np.flatnonzero(fits_a & fits_b) if len(spoken) else np.zeros(0, np.int64)
    counts = [np.array([len(x[k]) for k in good], np.int64) for x in (a, b)]
    flat = [np.fromiter((i for k in good for i in x[k]), np.int64, c.sum()) for x, c in zip((a, b), counts)]
    group_a, group_b, link_a, link_b = aligned(*flat, np.cumsum(left.sizes[flat[0]]), np.cumsum(right.sizes[flat[1]]))
    doc_a, doc_b = (np.repeat(np.arange(len(good)), c) for c in counts)
    n_groups = np.bincount(doc_b[np.flatnonzero(np.append(np.diff(group_b), 1))], minlength=len(good)) if len(good) else counts[0]
    # the string of groups: A's tokens of a group, then B's; each id brings the mark behind it
    names = left.names + right.names
    place_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
    order = np.zeros(len(group_a) + len(group_b), np.int64)
    order[place_a] = flat[0] + len(left.tokens) * (np.append(np.diff(group_a), 1) > 0)[: len(group_a)]
    order[place_b] = len(left.names) + flat[1] + len(right.tokens) * (np.append(np.diff(group_b), 1) > 0)[: len(group_b)]
    ends = np.append(0, np.cumsum(counts[0] + counts[1]))
    # each document's different linked pairs
    pairs = np.stack([doc_a[link_a], flat[0][link_a] << SHIFT | flat[1][link_b]])
    by = np.lexsort(pairs[::-1])
    pairs = pairs[:, by]
    heads = np.flatnonzero(np.append(True, (np.diff(pairs) != 0).any(0))) if pairs.shape[1] else np.zeros(0, np.int64)
    times, where = np.diff(np.append(heads, pairs.shape[1])), np.searchsorted(pairs[0][heads], np.arange(len(good) + 1))
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "pairs")}
    rows = spoken[good]
    for c, v in (("n_a", counts[0]), ("n_b", counts[1]), ("n_groups", n_groups), ("n_links", np.bincount(doc_a[link_a], minlength=len(good))), ("pairs", np.diff(where))):
        out[c][rows] = v
    digests = [""] * n
    for k, r in enumerate(rows.tolist()):
        digests[r] = hashlib.sha256(b"".join(map(names.__getitem__, order[ends[k] : ends[k + 1]].tolist()))[:-1]).hexdigest()
    lists = pa.array(np.append(0, np.cumsum(out.pop("pairs"))), pa.int32())
    found = pairs[1][heads]
    arrays = [pa.ListArray.from_arrays(lists, pa.array(v, pa.int32())) for v in (found >> SHIFT, found & (2**SHIFT - 1), times)]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, out.values()), pa.array(digests), *arrays], names=["id", *out, "groups_sha256", "a", "b", "times"])


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, docs, best) of every linked id pair: its links corpus-wide, its documents, whether it is the first of its B id."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, n, docs = (np.concatenate([h[i] for h in held]) for i in range(3))
            found, total = _counted(keys, n)
            held[:] = [(found, total, _counted(keys, docs)[1])]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], names=["pair", "n", "docs"])

        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            held.append((a << SHIFT | b, times, np.ones(len(a), np.int64)))
            if sum(len(h[0]) for h in held) > 2 * COUNTED:
                ready = out()
                if len(ready) > COUNTED:
                    held.clear()
                    yield ready
        if held:
            yield out()

    counts = table.select("a", "b", "times").mapInArrow(work, "pair long, n long, docs long")
    counts = written(counts.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "pairs")
    of_b = F.expr(f"pair & {2**SHIFT - 1}L")
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, of_b == F.col("b")).select("pair", "n", "docs", (F.col("n") == F.col("most")).alias("best"))


def _with_counts(table: DataFrame, known: DataFrame, rest: bool) -> DataFrame:
    """table with n_best and count_sum of the pairs in known (bounded by who calls), and with rest also the others' pairs and times."""
    got = known.select("pair", "n", "best").toArrow().sort_by("pair")
    pairs, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = table.sparkSession.sparkContext.broadcast((pairs, n, best))
    schema = BASE + ", row long, n_best long, count_sum decimal(38,0)" + (", pair array<long>, times array<int>" if rest else "")
    names = [*(c.split()[0] for c in BASE.split(", ")), "row", "n_best", "count_sum", *(["pair", "times"] if rest else [])]

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            keys, lengths = a << SHIFT | b, batch.column("a").value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(batch)), lengths)
            at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
            hit = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            sums = np.zeros(len(batch), object)
            count = n[at[hit]]
            if count.max(initial=0) * int(times.max(initial=0)) * max(1, len(keys)) < 2**62:
                own = np.zeros(len(batch), np.int64)
                np.add.at(own, doc[hit], count * times[hit])
                sums = own
            else:
                np.add.at(sums, doc[hit], count.astype(object) * times[hit])
            firsts = np.zeros(len(batch), np.int64)
            np.add.at(firsts, doc[hit], times[hit] * best[at[hit]])
            total = pa.array(sums, pa.int64()).cast(pa.decimal128(38, 0)) if sums.dtype != object else pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            columns = [*(batch.column(c) for c in names[:7]), pa.array(firsts), total]
            if rest:
                where = pa.array(np.append(0, np.cumsum(np.bincount(doc[~hit], minlength=len(batch)))), pa.int32())
                columns += [pa.ListArray.from_arrays(where, pa.array(keys[~hit])), pa.ListArray.from_arrays(where, pa.array(times[~hit], pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(work, schema)


def link_counts(table: DataFrame, in_memory: int | None = None) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of align()'s table.

    n_best: links whose pair is linked as often as any of its B id; count_sum: the sum of pairs' counts over links.
    """
    in_memory = IN_MEMORY if in_memory is None else in_memory
    counts = written(pair_counts(table), "counts")
    if counts.count() <= in_memory:
        return _with_counts(table, counts, False)
    hot = max(2, table.count() // 10_000)  # documents; doubled until the pairs of so many fit
    while counts.filter(F.col("docs") >= hot).count() > in_memory:
        hot *= 2
    part = written(_with_counts(table, counts.filter(F.col("docs") >= hot), True), "partial")
    few = part.select("row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("row", "x.pair", "x.times")
    few = few.join(counts.filter(F.col("docs") < hot).select("pair", "n", "best"), "pair")
    few = few.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("more_best"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("times")).alias("more_sum"))
    kept = part.drop("pair", "times").join(few, "row", "left")
    return kept.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).cast("decimal(38,0)")).drop("more_best", "more_sum")
