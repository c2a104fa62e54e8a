"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are tokenised from their distinct words where the tokenizer allows it, else whole; longer documents are cut into
full pieces and a rest. Full
pieces are sequences of their own. The others are dealt into groups of bounded size; each group is packed by several
islands (tasks with their own populations). Crossover injects whole well-filled bins of one parent into the other, drops
the bins that hold a document twice, and best-fits the displaced documents; after each epoch an island gets the elite of
its neighbour. The sequences that the groups leave poorly filled are opened once more and packed again in new groups,
so that what a group cannot fill well meets what others cannot.

Edge cases: a null or empty text is one piece of one token (the end mark); equal ids are packed each on their own row;
an empty table gives an empty result; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut_lineage, lean, small_batches, text_chunks, word_hashes, written

CAPACITY, END = 4096, 1
GROUP = 1500  # pieces that one island packs at once
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 6, 8
SLOT_BITS, KEPT_IDS = 21, 6_000_000  # words, and their ids, that a worker remembers; more are encoded anew
CHUNK = 1_000_000  # bytes of text at once
ENCODED = 2_000  # words that the tokenizer gets at once: what it returns for each is large
_U = np.uint64

#: Kinds of bytes: white space, ASCII letters, punctuation that the word tokenizer always splits from an ASCII letter
#: beside it, and all others. Only a letter and a point add up to 3.
KIND = np.full(256, 8, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
KIND[list(b".,;:!?%*&#$")] = 2

# What a tokenizer must do before its model for texts to be encoded word by word.
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)


def is_wordwise(definition: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and splits there before anything else."""
    normalizer, split = WORDWISE
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    return definition.get("normalizer") == normalizer and steps[0] == split and all((t["special"], t["normalized"], t["lstrip"], t["rstrip"]) == (True, False, False, False) and not re.search(r"\s", t["content"]) and t["content"].startswith("<|") for t in definition.get("added_tokens") or [])


class TextIds:
    """Ids of whole texts; of a tokenizer that is_wordwise from ids of their distinct words, of any other text by text.

    A word-wise tokenizer splits at white space, and between an ASCII letter and a point, before anything else; so a text's
    ids are those of its words so split. Its special tokens are matched with their case, so a chunk that may hold one
    keeps its case. Words are remembered in a table with one place for each value of some bits of their hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        definition = json.loads(self.tokenizer.to_str())
        self.wordwise = is_wordwise(definition)
        self.mark = next(((t["content"], t["id"]) for t in definition.get("added_tokens") or []), None)
        self.hash, self.first, self.count = (np.zeros(1 << SLOT_BITS, t) for t in (np.uint64, np.int64, np.int32))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = (np.zeros(1 << SLOT_BITS, t) for t in (np.int64, np.int32))  # a word's bytes in text
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0

    def learn(self, words: list[str]) -> np.ndarray:
        """Appends the ids of words to ids; where each word's begin, and the end of the last."""
        lengths = []
        for i in range(0, len(words), ENCODED):
            part = words[i : i + ENCODED]
            if self.mark and not any("<|" in w for w in part):  # one text, words parted by a token of its own
                found = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(part)], add_special_tokens=False)[0].ids, np.uint32)
                edges = np.concatenate([[-1], np.flatnonzero(found == self.mark[1]), [len(found)]])
                own, lengths_ = found[found != self.mark[1]], np.diff(edges) - 1
            else:
                each = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                own, lengths_ = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])
            while self.used + len(own) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
            self.ids[self.used : self.used + len(own)] = own
            self.used += len(own)
            lengths.append(lengths_)
        lengths = np.concatenate(lengths)
        return self.used - lengths.sum() + np.append(0, np.cumsum(lengths))

    def differ(self, seen: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether the bytes of each word (at starts of seen, so many) differ from those remembered at `at` (own many)."""
        out = own != sizes
        same = np.flatnonzero(~out)
        n = sizes[same].astype(np.int64)
        ends = np.cumsum(n)
        if len(same):
            inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
            unequal = seen[inner + np.repeat(starts[same], n)] != self.text[inner + np.repeat(at[same], n)]
            out[same] = np.add.reduceat(unequal, ends - n, dtype=np.int64) > 0
        return out

    def remember(self, seen: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keeps the bytes of words; where each word's are."""
        ends = np.cumsum(sizes, dtype=np.int64)
        while self.text_used + ends[-1] > len(self.text):
            self.text = np.append(self.text, np.zeros(len(self.text), np.uint8))
        inner = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        self.text[self.text_used : self.text_used + ends[-1]] = seen[inner + np.repeat(starts, sizes)]
        self.text_used += int(ends[-1])
        return self.text_used - ends[-1] + ends - sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end)."""
        if not self.wordwise:
            raw = data.tobytes()
            each = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:z].decode() for a, z in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.uint32), np.append(0, np.cumsum([len(x) for x in each]))
        starts, stops, words_of = parts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        lower = None if b"<|" in raw else LOWER
        hashes, seen, sizes = word_hashes(data, starts, stops, lower) | _U(1), data if lower is None else lower[data], stops - starts
        if self.used > KEPT_IDS or self.text_used > 8 * KEPT_IDS:
            self.hash[:], self.used, self.text_used = 0, 0, 0
        slot = (hashes >> _U(64 - SLOT_BITS)).astype(np.int64)
        first, count = self.first[slot], self.count[slot]
        known = self.hash[slot] == hashes
        known[known] = ~self.differ(seen, starts[known], sizes[known], self.at[slot[known]], self.size[slot[known]])
        missed = np.flatnonzero(~known)
        if len(missed):
            words = [raw[a:z].decode("utf-8", "replace") for a, z in zip(starts[missed].tolist(), stops[missed].tolist())]
            fresh, at, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            where = self.learn([words[k] for k in at])
            own, lengths, kept = slot[missed[at]], np.diff(where), self.remember(seen, starts[missed[at]], sizes[missed[at]])
            self.hash[own], self.first[own], self.count[own], self.at[own], self.size[own] = fresh, where[:-1], lengths, kept, sizes[missed[at]]
            first[missed], count[missed] = where[:-1][inverse], lengths[inverse]
            odd = np.flatnonzero(self.differ(seen, starts[missed], sizes[missed], kept[inverse], sizes[missed[at]][inverse]))
            if len(odd):  # other words of an equal hash
                where = self.learn([words[k] for k in odd])
                first[missed[odd]], count[missed[odd]] = where[:-1], np.diff(where)
        ends = np.cumsum(count, dtype=np.int64)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends + count, count)]
        return ids, np.append(0, ends)[words_of]


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of what a word-wise tokenizer encodes on its own, and the first of each text (one more at the end)."""
    kind = KIND[data]
    inside = kind != 0
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        cut = kind[:-1] + kind[1:] == 3
        begins[1:] &= ~inside[:-1] | cut
        ends[:-1] &= ~inside[1:] | cut
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        ends[edges] = inside[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def text_ids(path: str) -> TextIds:
    """The worker process's own TextIds, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_text_ids", {})
    if path not in kept:
        kept[path] = TextIds(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc): tokens and end mark of every document, cut only where longer than capacity."""
    schema = "id long, piece int, start long, length long, crc long"

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = text_ids(tokenizer)
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for first, last, data, offsets in text_chunks(b.column(1), CHUNK):
                ids, where = words.encode(data, offsets)
                rows = []
                for d in range(last - first):
                    own = np.append(ids[where[d] : where[d + 1]], np.uint32(END)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((ids_of[first + d], piece, at, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "crc"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


# A packing is a list of bins, a bin a list of item numbers.


def best_fit(bins: list[list[int]], free: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts items, longest first, each into the fullest bin that takes it, else into a new one."""
    room = sorted((r, j) for j, r in enumerate(free) if r)
    for i in sorted(items, key=lambda i: -size[i]):
        k = bisect_left(room, (size[i], -1))
        if k == len(room):
            bins.append([i])
            free.append(capacity - size[i])
            if free[-1]:
                insort(room, (free[-1], len(bins) - 1))
            continue
        left, j = room.pop(k)
        bins[j].append(i)
        free[j] = left - size[i]
        if free[j]:
            insort(room, (free[j], j))


def cost(packing: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins as unevenly filled as can be, so that some are nearly empty."""
    return len(packing), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in packing)


def fullest(items: list[int], size: list[int], capacity: int, random: Random, noise: float = 0.3) -> list[list[int]]:
    """Bins filled one after another: the longest item left (with chance noise any), then items until the best one or two fill it."""
    order = sorted(items, key=lambda i: (size[i], i))
    ids, left, bins = np.array(order, np.int64), np.array([size[i] for i in order], np.int64), []
    while len(left):
        j = random.randrange(len(left)) if random.random() < noise else len(left) - 1
        own, taken = [j], np.zeros(len(left), bool)
        taken[j] = True
        room = capacity - int(left[j])
        while room > 0:
            free = np.flatnonzero(~taken)
            v = left[free]
            top = int(np.searchsorted(v, room, "right"))
            if not top:
                break
            second = np.searchsorted(v, room - v[:top], "right") - 1  # the longest that fits beside each
            second = np.where(second == np.arange(top), second - 1, second)
            both = v[:top] + np.where(second >= 0, v[second], 0)
            best = int(both.argmax())
            pair = [best, int(second[best])] if second[best] >= 0 else [best]
            if both[best] < v[top - 1]:
                pair = [top - 1]
            if room - sum(int(v[x]) for x in pair) > 0.002 * capacity and 3 * int(v[0]) <= room:
                pair = [random.randrange(top)]  # three or more may fill it better
            own += [int(free[x]) for x in pair]
            taken[free[pair]] = True
            room -= sum(int(v[x]) for x in pair)
        bins.append([int(ids[x]) for x in own])
        left, ids = left[~taken], ids[~taken]
    return bins


def filled(b: list[int], size: list[int]) -> int:
    return sum(size[i] for i in b)


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, random: Random) -> list[list[int]]:
    """A child of a with well-filled bins of b: a's bins that hold their documents go, unless fuller, and the displaced are best-fitted.

    Bins come in order of their fill, those of both parents; at some fill, drawn at random, the injection ends.
    """
    ends = capacity * (1 - 0.08 * random.random() ** 2)
    both = sorted([(-filled(x, size), random.random(), x) for x in a] + [(-f, random.random(), x) for x in b if (f := filled(x, size)) >= ends])
    bins, inside = [], set()
    for fill, _, x in both:
        if -fill >= ends and inside.isdisjoint(x):
            bins.append(list(x))
            inside.update(x)
    loose = []
    for x in a:
        if inside.isdisjoint(x):
            bins.append(list(x))
            inside.update(x)
        else:
            loose += [i for i in x if i not in inside]
    free = [capacity - filled(x, size) for x in bins]
    best_fit(bins, free, loose, size, capacity)
    return bins


def mutate(a: list[list[int]], size: list[int], capacity: int, random: Random) -> list[list[int]]:
    """Opens the emptiest bins and some others, and fills bins with their documents anew."""
    order = sorted(range(len(a)), key=lambda j: filled(a[j], size))
    n = max(1, len(a) // 10)
    drop = {*order[:n], *random.sample(order, min(len(order), 3 * n))}
    return [list(x) for j, x in enumerate(a) if j not in drop] + fullest([i for j in drop for i in a[j]], size, capacity, random)


def evolve(size: list[int], capacity: int, seed: int, elite: list[list[int]] | None, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing of one island's epoch; stops as soon as no packing can have fewer bins."""
    random, least = Random(seed), max(-(-sum(size) // capacity), sum(2 * n > capacity for n in size))
    whole: list[list[int]] = []
    best_fit(whole, [], list(range(len(size))), size, capacity)
    people = [whole] + ([elite] if elite else [])
    while len(people) < population and min(map(len, people)) > least:
        people.append(fullest(list(range(len(size))), size, capacity, random, random.choice([0.0, 0.1, 0.3])))
    rank = lambda p: cost(p, size, capacity)
    people.sort(key=rank)
    for _ in range(generations):
        if len(people[0]) <= least or len(people) < 2:
            break
        other = random.choice(people[1:])
        children = [crossover(people[0], other, size, capacity, random), crossover(other, people[0], size, capacity, random), mutate(people[0], size, capacity, random), mutate(other, size, capacity, random)]
        people = sorted(people + children, key=rank)[:population]
    return people[0]


def _islands(rows: DataFrame, capacity: int) -> DataFrame:
    """(key, grp, length, bin) of rows(key, grp, length): each group's best packing of all its islands."""
    schema = "grp long, island int, keys array<long>, lengths array<int>, bins array<int>, count int"
    packed = rows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("items"))  # at most GROUP pieces
    packed = packed.select("grp", F.col("items.key").alias("keys"), F.col("items.length").cast("array<int>").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = packed.select("grp", "island", "keys", "lengths", F.lit(None).cast("array<int>").alias("bins"))
    for epoch in range(EPOCHS):

        @lean
        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, counts = [], []
                for grp, island, lengths, elite in zip(*(b.column(c).to_pylist() for c in ("grp", "island", "lengths", "bins"))):
                    packing = None
                    if elite is not None:
                        packing = [[] for _ in range(max(elite) + 1)]
                        for i, j in enumerate(elite):
                            packing[j].append(i)
                    best = evolve(lengths, capacity, hash((grp, island, epoch)), packing)
                    where = [0] * len(lengths)
                    for j, items in enumerate(best):
                        for i in items:
                            where[i] = j
                    out.append(where)
                    counts.append(len(best))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "island", "keys", "lengths")), pa.array(out, pa.list_(pa.int32())), pa.array(counts, pa.int32())], names=["grp", "island", "keys", "lengths", "bins", "count"])

        state = state.select("grp", "island", "keys", "lengths", "bins").mapInArrow(run, schema)
        if epoch + 1 < EPOCHS:  # migration: each island gets the elite of the next one
            ring = Window.partitionBy("grp").orderBy("island")
            elite = F.coalesce(F.lead("bins").over(ring), F.first("bins").over(ring))
            state = state.withColumn("bins", elite)
    best = state.groupBy("grp").agg(F.min_by(F.struct("keys", "lengths", "bins"), F.struct("count", "island")).alias("best"))
    return best.select("grp", F.explode(F.arrays_zip("best.keys", "best.lengths", "best.bins")).alias("x")).select(F.col("x.keys").alias("key"), "grp", F.col("x.lengths").alias("length"), F.col("x.bins").alias("bin"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(key, length) with a group of about GROUP pieces each, by a hash of the key."""
    groups = max(1, round(rows.count() / GROUP))
    return rows.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(groups)), F.lit(groups)))


def pack(rows: DataFrame, capacity: int = CAPACITY, full: float = 0.999) -> DataFrame:
    """(key, sequence_id, offset) of rows(key, length): every piece's sequence and its place there.

    full: sequences filled less than this are opened once more and packed in new groups.
    """
    whole = rows.filter(F.col("length") == capacity).select("key", F.struct(F.lit(0).alias("round"), F.col("key").alias("grp"), F.lit(0).alias("bin")).alias("seq"), "length")
    first = written(_islands(_dealt(rows.filter(F.col("length") < capacity).select("key", "length")), capacity), "packed")
    fill = first.groupBy("grp", "bin").agg((F.sum("length") >= full * capacity).alias("full"))
    marked = cut_lineage(first.join(fill, ["grp", "bin"]))
    done = marked.filter("full").select("key", F.struct(F.lit(1).alias("round"), "grp", "bin").alias("seq"), F.col("length").cast("long").alias("length"))
    again = _islands(_dealt(marked.filter("not full").select("key", "length")), capacity)
    again = again.select("key", F.struct(F.lit(2).alias("round"), "grp", "bin").alias("seq"), F.col("length").cast("long").alias("length"))
    placed = whole.unionByName(done).unionByName(again)
    own = Window.partitionBy("seq").orderBy("key")  # at most `capacity` pieces
    number = F.when(F.col("seq.round") == 0, F.col("seq.grp") * 4).otherwise((F.col("seq.grp") * 2**20 + F.col("seq.bin")) * 4 + F.col("seq.round"))
    return placed.select("key", number.alias("sequence_id"), (F.sum("length").over(own) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) of every piece of docs."""
    cut = cut_lineage(pieces(docs, tokenizer, id_col, text_col, capacity)).withColumn("key", F.monotonically_increasing_id())
    return cut.join(pack(cut.select("key", "length"), capacity), "key").drop("key")
