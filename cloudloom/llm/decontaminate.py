"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words (ASCII case and punctuation aside). A CGK walk reads a sequence with a pointer that moves or
stays by a random bit of the step and the word read, so sequences a few edits apart mostly yield equal outputs at equal
steps: edit distance becomes Hamming distance. Walks start at every word of every document and at every word of every
item. Their windows go by the item's length, up to 28 steps: under many edits two walks over all of a long item agree in
few steps, so a long item is covered by several windows, any of which can meet. Each of `samplings` repetitions hashes
a few random steps of a walk, and equal hashes make a candidate (document, item, place). Each candidate is verified by the exact edit distance, in words,
between the whole item and the best-fitting stretch of the document. samplings follows from the target recall and the
windows of an item, and goes by item length, as a window counts only if its walk ends inside the item. Items of fewer
than LEAST_WORDS words offer too few windows and are looked up without chance: an item that may have e edits is cut into e + 1
pieces, one of which every leak holds unedited, and where a piece stands the whole item is verified.

Documents stay where they are: only items travel, in blocks of a bounded number and size (one item is never split), one
pass over the documents a block. Equal items are looked for once.

Edge cases: null or blank texts and items hold no words and match nothing; an item of a single word is in every document
that holds the word; equal items are each reported; repeated rows are judged each; other columns are ignored; a table
without items finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, lean, mix, small_batches, spans, text_chunks, word_hashes

#: Items, and bytes of them, of one pass over the documents; more items take more passes.
ITEMS, ITEM_BYTES = 20_000, 1_000_000
#: Plans by item length: least words, sampled steps, steps they are sampled from, windows that count as independent
#: (valid ones overlap; so many give the target recall at the full edit rate for every length of the class).
PLANS = ((8, 4, (6, 8, 10), 3), (12, 4, (10, 12), 4.2), (31, 8, (20, 24, 28), 8))
WALKS = 2  # independent walks; repetitions take turns
CHUNK = 250_000  # bytes of text at once: its arrays stay in a core's cache
EDIT_RATE, RECALL, DIFFERING = 0.2, 0.99, 0.3
LEAST_WORDS = 8
SLICE = 200_000  # candidates of short items that are verified at once
_U = np.uint64
TABLE_BITS = 20

#: ASCII bytes that are no letter or digit separate words.
OUTSIDE = np.ones(256, bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = False
OUTSIDE[0x80:] = False


def samplings(sampled: int, windows: float, recall: float = RECALL, differing: float = DIFFERING) -> int:
    """Repetitions after which an item is hit with the target recall, if each of its windows differs in that share of steps."""
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing) ** sampled) / windows))


@dataclass(frozen=True)
class Repetition:
    walk: int
    steps: tuple[int, ...]
    plan: int


def repetitions(recall: float, plans: set[int], seed: int = 7) -> list[Repetition]:
    """All repetitions of the plans of that number."""
    random, out = np.random.default_rng(seed), []
    for p, (_, sampled, spans_, windows) in enumerate(PLANS):
        count = samplings(sampled, windows, recall) if p in plans else 0
        out += [Repetition(r % WALKS, tuple(sorted(random.choice(spans_[r % len(spans_)], sampled, replace=False).tolist())), p) for r in range(count)]
    return out


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, where each row's begin and end)."""
    for first, last, data, offsets in text_chunks(column, CHUNK):
        starts, stops, where = spans(data, offsets, OUTSIDE)
        yield first, last, word_hashes(data, starts, stops) | _U(1), where


def embed(words: np.ndarray, where: np.ndarray, plan: list[Repetition]) -> list[np.ndarray]:
    """Keys of each repetition for the window that starts at each word; 0 for a window that runs past its text.

    0 stands behind every text: a walk that reaches it stays there.
    """
    n, lengths = len(where) - 1, np.diff(where)
    longest = max((r.steps[-1] for r in plan), default=0)
    padded = np.zeros(len(words) + n * (longest + 2), np.uint64)
    at = np.arange(len(words)) + np.repeat(np.arange(n) * (longest + 2), lengths)
    padded[at] = words
    keys = [np.full(len(words), _U(j + 1) << _U(40), np.uint64) for j in range(len(plan))]
    factors = constants(32, 23)
    with np.errstate(over="ignore"):
        for walk in {r.walk for r in plan}:
            mine = [(j, r.steps) for j, r in enumerate(plan) if r.walk == walk]
            bits = mix(padded ^ constants(WALKS, 29)[walk]).view(np.int64)
            bits[padded == 0] = 0
            pointer = at.copy()
            for t in range(max(steps[-1] for _, steps in mine) + 1):
                asked = [(j, steps) for j, steps in mine if t in steps]
                if asked:
                    out = padded[pointer]
                    for j, steps in asked:
                        keys[j] += out * factors[steps.index(t)]
                        if t == steps[-1]:  # a walk that is past the end stays there, so the last step tells
                            keys[j][out == 0] = 0
                pointer += (bits[pointer] >> t) & 1
    return keys


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Keys of each run of n words."""
    with np.errstate(over="ignore"):
        return sum(words[j : len(words) - n + 1 + j] * f for j, f in enumerate(constants(n, 31)))


@dataclass
class Items:
    """Benchmark items ready to be looked for."""

    ids: list[list[int]]  # of each different text, all ids
    words: list[np.ndarray]
    distinct: list[set[int]]
    most: list[int]  # edits allowed
    plan: list[Repetition]
    tables: list[np.ndarray]  # of each repetition: which slots hold a key
    keys: list[np.ndarray]  # sorted keys
    entry: list[np.ndarray]  # of each key, its word's place among the words of all items
    starts: np.ndarray  # where each item's words begin there
    exact: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length of short items: sorted keys, item of each
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each length of pieces of short items with edits: sorted keys, item, its words before


def prepare(rows: list[tuple[int, str]], rate: float = EDIT_RATE, recall: float = RECALL) -> Items:
    ids, words, seen = [], [], {}
    for first, last, hashes, where in words_of(pa.array([t for _, t in rows], pa.string())):
        for d in range(last - first):
            own = hashes[where[d] : where[d + 1]]
            if len(own):
                i = seen.setdefault(own.tobytes(), len(ids))
                if i == len(ids):
                    ids.append([])
                    words.append(own)
                ids[i].append(rows[first + d][0])
    sizes = np.array([len(w) for w in words], np.int64)
    most = (rate * sizes).astype(int)
    kind = np.maximum(np.searchsorted([p[0] for p in PLANS], sizes, "right") - 1, 0)
    kind[sizes < LEAST_WORDS] = -1
    out = Items(ids, words, [set(w.tolist()) for w in words], most.tolist(), repetitions(recall, set(kind.tolist())), [], [], [], np.zeros(1, np.int64), {}, {})
    for n in np.unique(sizes[sizes < LEAST_WORDS]).tolist():
        own = np.flatnonzero(sizes == n)
        key = runs(np.concatenate([words[i] for i in own]), n)[::n]
        order = np.argsort(key, kind="stable")
        out.exact[n] = key[order], own[order]
    cut: dict[int, list[tuple[int, int, int]]] = {}
    for i in np.flatnonzero((sizes < LEAST_WORDS) & (most > 0)).tolist():
        n, parts = len(words[i]), min(most[i] + 1, len(words[i]))
        for j in range(parts):
            a, z = n * j // parts, n * (j + 1) // parts
            cut.setdefault(z - a, []).append((int(runs(words[i][a:z], z - a)[0]), i, a))
    for n, found in cut.items():
        found.sort()
        out.pieces[n] = tuple(np.array(c, t) for c, t in zip(zip(*found), (np.uint64, np.int64, np.int64)))
    if words:
        where = np.concatenate([[0], np.cumsum(sizes)])
        item = np.repeat(np.arange(len(words)), sizes)
        out.starts = where[:-1]
        for repetition, key in zip(out.plan, embed(np.concatenate(words), where, out.plan)):
            use = (key != 0) & (kind[item] == repetition.plan)
            use = np.flatnonzero(use)
            order = use[np.argsort(key[use], kind="stable")]
            table = np.zeros(1 << TABLE_BITS, bool)
            table[_slot(key[use])] = True
            out.tables.append(table)
            out.keys.append(key[order])
            out.entry.append(order.astype(np.int32))
    return out


def _slot(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - TABLE_BITS)).astype(np.int64)


def fitting(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edits between item and any stretch of text, end of the first such stretch)."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def exact_in(words: np.ndarray, where: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(document, item): (0, first word, word after the last)} of the short items, the first place of each."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, (keys, owner) in items.exact.items():
        key = runs(words, n) if len(words) >= n else words[:0]
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        at = np.flatnonzero(high > low)
        doc = np.searchsorted(where, at, "right") - 1
        inside = at + n <= where[doc + 1]
        at, doc = at[inside], doc[inside]
        _, first = np.unique(np.stack([doc, low[at]]), axis=1, return_index=True)
        for j in first.tolist():
            d, a = int(doc[j]), int(at[j])
            for i in owner[low[a] : high[a]].tolist():
                if (items.words[i] == words[a : a + n]).all():
                    out[d, i] = (0, a - int(where[d]), a + n - int(where[d]))
    return out


def one_edit(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each row of text (one word more than a row of item) begins with that row of item, but for one edit at most."""
    m = item.shape[1]
    same = text[:, :m] == item
    first = np.where(same.all(1), m, (~same).argmax(1))  # words before the first that differs
    tail = lambda equal: np.where(equal.all(1), equal.shape[1], (~equal[:, ::-1]).argmax(1)) if equal.shape[1] else np.zeros(len(item), np.int64)
    lost = tail(text[:, : m - 1] == item[:, 1:]) >= m - 1 - first
    more = tail(text[:, 1:] == item) >= m - first
    return ((~same).sum(1) <= 1) | lost | more


def edited_in(words: np.ndarray, where: np.ndarray, items: Items, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Adds to best the short items that stand in a document with edits: wherever one of their pieces does, all of them are verified."""
    padded = np.zeros(len(words) + 2 * LEAST_WORDS, np.uint64)
    padded[LEAST_WORDS : LEAST_WORDS + len(words)] = words
    for n, (keys, owner, before) in items.pieces.items():
        if len(words) < n:
            continue
        key = runs(words, n)
        at = np.flatnonzero(np.isin(key, keys))
        doc = np.searchsorted(where, at, "right") - 1
        at, doc = at[at + n <= where[doc + 1]], doc[at + n <= where[doc + 1]]
        low, high = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
        ends = np.cumsum(high - low)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, SLICE):  # a place and each piece that stands there
            pair = np.arange(begin, min(begin + SLICE, int(ends[-1])))
            place = np.searchsorted(ends, pair, "right")
            entry = low[place] + pair - (ends - (high - low))[place]
            _verify(words, where, padded, items, best, at[place], doc[place], owner[entry], before[entry], n)


def _verify(words: np.ndarray, where: np.ndarray, padded: np.ndarray, items: Items, best: dict, at: np.ndarray, doc: np.ndarray, item: np.ndarray, before: np.ndarray, n: int) -> None:
    """One slice of edited_in: candidates (place of a piece, document, item, words of the item before the piece)."""
    sizes, most = np.array([len(w) for w in items.words]), np.array(items.most)
    keep = np.ones(len(at), bool)
    for size, a in set(zip(sizes[item].tolist(), before.tolist())):
        own = np.flatnonzero((sizes[item] == size) & (before == a) & (most[item] == 1))
        if not len(own):
            continue
        whole = np.stack([items.words[i] for i in item[own].tolist()])
        right, left = size - a - n, a  # words of the item behind and before the piece; one of the two sides is empty
        begin, end = where[doc[own]], where[doc[own] + 1]
        if right:
            spot = at[own][:, None] + n + np.arange(right + 1)
            text = np.where(spot < end[:, None], padded[spot + LEAST_WORDS], 0)
            keep[own] = one_edit(whole[:, a + n :], text)
        else:
            spot = at[own][:, None] - 1 - np.arange(left + 1)
            text = np.where(spot >= begin[:, None], padded[spot + LEAST_WORDS], 0)
            keep[own] = one_edit(whole[:, :a][:, ::-1], text)
    for k in np.flatnonzero(keep).tolist():
        d, i, e = int(doc[k]), int(item[k]), items.most[item[k]]
        if best.get((d, i), (1 << 30,))[0] == 0:
            continue
        own, begin, end = items.words[i], int(where[d]), int(where[d + 1])
        a, z = max(begin, int(at[k] - before[k]) - e), min(end, int(at[k] - before[k]) + len(own) + e)
        edits, stop = fitting(own, words[a:z])
        _, back = fitting(own[::-1], words[a : a + stop][::-1])
        found = (edits, a + stop - back - begin, a + stop - begin)
        if edits <= e and found < best.get((d, i), (1 << 30,)):
            best[d, i] = found


def leaks_in(words: np.ndarray, where: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, first word, word after the last) of verified matches, the best of each document and item."""
    if not len(words) or not items.ids:
        return []
    best = exact_in(words, where, items)
    edited_in(words, where, items, best)
    keys = embed(words, where, items.plan)
    found_at, found_entry = [], []
    for r, key in enumerate(keys):
        hit = np.flatnonzero(items.tables[r][_slot(key)] & (key != 0))
        low = np.searchsorted(items.keys[r], key[hit], "left")
        high = np.searchsorted(items.keys[r], key[hit], "right")
        n = high - low
        hit, low, n = hit[n > 0], low[n > 0], n[n > 0]
        if len(hit):
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            found_at.append(np.repeat(hit, n))
            found_entry.append(items.entry[r][entry].astype(np.int64))
    if not found_at:
        return [(d, i, *x) for (d, i), x in sorted(best.items())]
    at, entry = np.concatenate(found_at), np.concatenate(found_entry)
    item = np.searchsorted(items.starts, entry, "right") - 1
    start, doc, most = at - (entry - items.starts[item]), np.searchsorted(where, at, "right") - 1, np.array(items.most)
    sizes = np.append(items.starts[1:], items.starts[-1] + len(items.words[-1])) - items.starts
    # a start that leaves more words of the item outside the document than it may lose to edits matches nothing
    inside = (start - where[doc] >= -most[item]) & (start + sizes[item] <= where[doc + 1] + most[item])
    start, doc, item = start[inside], doc[inside], item[inside]
    if not len(start):
        return [(d, i, *x) for (d, i), x in sorted(best.items())]
    near = (start - where[doc] + most[item]) // np.maximum(4, most[item])  # starts this close fit in one verified stretch
    _, first = np.unique((doc * len(items.ids) + item) * (int(near.max()) + 1) + near, return_index=True)
    listed, begins, ends = words.tolist(), where[doc[first]].tolist(), where[doc[first] + 1].tolist()
    for d, i, at_, begin, end in zip(doc[first].tolist(), item[first].tolist(), start[first].tolist(), begins, ends):
        own, slack = items.words[i], max(4, items.most[i]) + items.most[i] + 1
        a, z = max(begin, at_ - slack), min(end, at_ + len(own) + 2 * slack)
        if len(items.distinct[i].intersection(listed[a:z])) < len(items.distinct[i]) - items.most[i] or best.get((d, i), (1 << 30,))[0] == 0:
            continue
        text = words[a:z]
        edits, stop = fitting(own, text)
        if edits <= items.most[i] and edits < best.get((d, i), (1 << 30,))[0]:
            _, back = fitting(own[::-1], text[:stop][::-1])
            best[d, i] = (edits, a + stop - back - begin, a + stop - begin)
    return [(d, i, *x) for (d, i), x in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float, recall: float) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for block in range(blocks):
        own = rows if blocks == 1 else rows.filter(part == block)
        yield prepare([(r["id"], r["text"]) for r in own.orderBy("id", "text").collect()], rate, recall)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
    recall: float = RECALL,
) -> DataFrame:
    """(id, item, edits, words, first_word, last_word): benchmark items that documents hold with at most rate edits a word."""
    out, docs = None, small_batches(docs)
    for items in _blocks(benchmark, item_col, item_text_col, rate, recall):

        @lean
        def work(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, _, words, where in words_of(b.column(1)):
                    rows = [(b.column(0)[first + d].as_py(), own, edits, len(items.words[i]), a, z - 1) for d, i, edits, a, z in leaks_in(words, where, items) for own in items.ids[i]]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "item", "edits", "words", "first_word", "last_word"])

        own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, "id long, item long, edits long, words long, first_word long, last_word long")
        out = own if out is None else out.unionByName(own)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE, recall: float = RECALL) -> DataFrame:
    """The rows of docs that hold no benchmark item; a row is judged where it is, nothing is shuffled."""
    for items in _blocks(benchmark, item_col, item_text_col, rate, recall):
        place = small_batches(docs).columns.index(text_col)

        @lean
        def work(batches: Iterator[pa.RecordBatch], items: Items = items, place: int = place) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for first, _, words, where in words_of(b.column(place)):
                    clean[[first + d for d, *_ in leaks_in(words, where, items)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
