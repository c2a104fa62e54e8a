"""Quality rules: counts of whole texts, and a calibrated logistic regression on hashed word and character n-grams.

Words are runs without blank and 0x09-0x0D. The counts of a text, the hashes of its one- and two-word and three- and four-character
sequences, and their mean weights come from the same pass over Arrow batches. The regression is fitted to labelled rows: at most
SAMPLE_ROWS of each label (by a hash of the id), four fifths of them for the weights (L-BFGS; each step is a pass over the sample's
features, a table in the shared folder) and one fifth for the calibration (Platt's sigmoid, rows weighted by how many of their label
there are). A text is kept if it passes the counts and its calibrated probability of quality is KEEP or more.

Edge cases: a null, empty or blank text has no words, so it fails; null labels and labels of unknown rows teach nothing; several labels
of one id count once, as the smallest, and of several texts of a labelled id the smallest is learned from; without both labels
every probability is 1, so the counts decide; repeated and null ids are judged row by row; an empty table gives an empty result;
other columns are ignored. Lines and windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, constants, lean, mix, small_batches, spans, text_chunks, word_hashes, written
from .labels import fold

#: Rows of each label that are learned from; bits of a feature's number; folds, one of which calibrates.
SAMPLE_ROWS, BITS, FOLDS = 4000, 17, 5
#: The rules: words at least, percent of words in repeated windows of so many words, probability of quality at least.
LEAST_WORDS, MOST_REPEATED, WINDOW, KEEP = 20, 30, 8, 0.5
CHUNK = 1_000_000
SYMBOLS, LINE_ENDS = np.zeros(256, bool), np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINE_ENDS[0x0A] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64


def per_text(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Sums of values from where[d] to where[d + 1]."""
    out = np.zeros(len(where) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(np.diff(where))
    if len(some):
        out[some] = np.add.reduceat(values, where[some], dtype=out.dtype)
    return out


def again(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each hash occurs in its text."""
    _, inverse, times = np.unique(mix(hashes ^ mix(text.astype(_U) + _U(1))), return_inverse=True, return_counts=True)
    return times[inverse]


@dataclass
class Texts:
    """Whole texts of a chunk: UTF-8 bytes, offsets, words and their hashes."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        self.starts, self.stops, self.first = spans(self.data, self.offsets)
        self.words = word_hashes(self.data, self.starts, self.stops, None)

    def counts(self) -> dict[str, np.ndarray]:
        n = len(self.offsets) - 1
        texts = np.arange(n)
        inside = ~SPACES[self.data]
        leads = (self.data & 0xC0) != 0x80
        starts, stops, first = spans(self.data, self.offsets, LINE_ENDS)
        seen = np.append(0, np.cumsum(inside))
        spoken = seen[stops] > seen[starts]
        line_text = np.repeat(texts, np.diff(first))[spoken]
        times = again(word_hashes(self.data, starts[spoken], stops[spoken], None), line_text)
        different = np.bincount(line_text, weights=1 / times, minlength=n).round().astype(np.int64)
        return {
            "n_words": np.diff(self.first),
            "word_chars": per_text(inside & leads, self.offsets),
            "n_symbols": per_text(SYMBOLS[self.data], self.offsets),
            "n_dup_lines": np.bincount(line_text, minlength=n) - different,
            "n_repeat_words": self.repeated(),
        }

    def repeated(self) -> np.ndarray:
        """Words in windows that their text holds twice or more."""
        hashes, where = sequences(self.words, self.first, WINDOW, 5)
        own = np.diff(where)
        begin = np.arange(len(hashes)) - np.repeat(where[:-1], own) + np.repeat(self.first[:-1], own)
        twice = begin[again(hashes, np.repeat(np.arange(len(own)), own)) > 1]
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, twice, 1)
        np.add.at(steps, twice + WINDOW, -1)
        return per_text(np.cumsum(steps[:-1]) > 0, self.first)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers, where each text's begin) of every kind: words, pairs of words, three and four characters."""
        letters = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(_U)
        ends = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))[self.offsets]
        for kind, (items, first, k) in enumerate(((self.words, self.first, 1), (self.words, self.first, 2), (letters, ends, 3), (letters, ends, 4))):
            hashes, where = sequences(items, first, k, 100 + kind)
            yield (hashes >> _U(64 - BITS)).astype(np.int64), where


def sequences(items: np.ndarray, first: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k items in a row of one text, and where each text's begin (one more at the end)."""
    own = np.maximum(np.diff(first) - k + 1, 0)
    where = np.append(0, np.cumsum(own))
    if not where[-1]:
        return np.zeros(0, _U), where
    factors = constants(k, seed)
    with np.errstate(over="ignore"):
        rolled = sum(items[j : len(items) - k + 1 + j] * factors[j] for j in range(k))
    valid = np.ones(len(rolled) + k - 1, bool)
    for j in range(1, k):
        last = first[1:] - j
        valid[last[last >= 0]] = False  # would reach into the next text
    return mix(rolled[valid[: len(rolled)]]), where


@dataclass
class Model:
    """Weights of features, and the sigmoid of their mean: probability = 1 / (1 + exp(-(slope * margin + bias)))."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    slope: float = 0.0
    bias: float = 50.0

    def margins(self, texts: Texts) -> np.ndarray:
        total = np.zeros(len(texts.offsets) - 1)
        for numbers, where in texts.grams():
            total += per_text(self.weights[numbers].astype(np.float64), where) / np.maximum(1, np.diff(where))
        return total

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.bias, -50, 50)))


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, passes: int = 25, memory: int = 8, enough: float = 1e-2) -> np.ndarray:
    """L-BFGS with backtracking; loss gives a value and its gradient, each call is a pass over the sample."""
    w, (value, slope) = start, loss(start)
    first, pairs, used = np.linalg.norm(slope), [], 1
    while used < passes and np.linalg.norm(slope) > enough * first:
        way, sizes = slope.copy(), []
        for s, y in reversed(pairs):
            sizes.append((s @ way) / (s @ y))
            way -= sizes[-1] * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / first
        for (s, y), a in zip(pairs, reversed(sizes)):
            way += (a - (y @ way) / (s @ y)) * s
        step = 1.0 if pairs else 10.0
        while True:
            new, used = w - step * way, used + 1
            after, other = loss(new)
            if after <= value - 1e-4 * step * (slope @ way) or used >= passes:
                break
            step /= 4
        if after >= value:
            break
        s, y = new - w, other - slope
        pairs = [*pairs, (s, y)][-memory:] if s @ y > 0 else pairs
        w, value, slope = new, after, other
    return w


def sigmoid(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Platt's slope and bias, by Newton steps; targets are drawn in by one row of each label."""
    n = [(y == c).sum() for c in (0, 1)]
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    scale = max(1e-12, np.abs(margins).max(initial=0))
    x, v = np.column_stack([margins / scale, np.ones(len(y))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weights * (p - target)))
        v -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(v[0], 0.0) / scale), float(v[1])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[DataFrame, list[int]]:
    """(y, calibrates, text) of at most sample_rows labelled ids of each label, one text an id, and how many ids have each label."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col)).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in parts[0].unionByName(parts[1]).collect()], "id long, y int")  # 2 * sample_rows at most
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    one = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).filter("text is not null")
    return one.select("y", (fold("id", FOLDS) == 0).alias("calibrates"), "text"), [sizes.get(0, 0), sizes.get(1, 0)]


def features(rows: DataFrame) -> DataFrame:
    """(y, calibrates, numbers, values) of rows(y, calibrates, text): a text's sparse vector, as a table in the shared folder."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in text_chunks(batch.column("text"), CHUNK):
                every = list(Texts(data, offsets).grams())
                numbers, values = [], []
                for d in range(z - a):
                    own = [x[w[d] : w[d + 1]] for x, w in every]
                    found, inverse = np.unique(np.concatenate(own), return_inverse=True)
                    numbers.append(found.astype(np.int32))
                    values.append(np.bincount(inverse, weights=np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in own]), minlength=len(found)).astype(np.float32))
                where = pa.array(np.append(0, np.cumsum([len(x) for x in numbers])), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("y")[a:z], batch.column("calibrates")[a:z], pa.ListArray.from_arrays(where, pa.array(np.concatenate(numbers))), pa.ListArray.from_arrays(where, pa.array(np.concatenate(values)))], names=["y", "calibrates", "numbers", "values"])

    return written(rows.mapInArrow(work, "y int, calibrates boolean, numbers array<int>, values array<float>"), "quality")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, ridge: float = 1e-6) -> Model:
    """A model from docs and labels(id_col, label_col), 1 for quality; ridge: of a weight's square against the mean loss of a row."""
    rows, sizes = sample(docs, labels, id_col, text_col, label_col, sample_rows)
    table = features(rows)
    got = {(r["calibrates"], r["y"]): r["count"] for r in table.groupBy("calibrates", "y").count().collect()}
    seen = [got.get((False, y), 0) + got.get((True, y), 0) for y in (0, 1)]
    if not all(got.get((False, y), 0) for y in (0, 1)):
        return Model()
    context, learn = table.sparkSession.sparkContext, table.filter("not calibrates").coalesce(16)  # the sample is bounded
    balance = [0.5 / got[False, y] for y in (0, 1)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(w)

        @lean
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            value, slope = 0.0, np.zeros(len(w))
            for b in batches:
                if not len(b):
                    continue
                y, numbers, x, lengths = b.column("y").to_numpy(), b.column("numbers").flatten().to_numpy(), b.column("values").flatten().to_numpy().astype(np.float64), b.column("numbers").value_lengths().to_numpy()
                z = per_text(w[numbers] * x, np.append(0, np.cumsum(lengths))) + w[-1]
                sign = np.where(y == 1, 1.0, -1.0)
                share = np.where(y == 1, balance[1], balance[0])
                value += float((share * np.logaddexp(0, -sign * z)).sum())
                pull = -share * sign / (1 + np.exp(np.clip(sign * z, -500, 500)))
                slope += np.bincount(numbers, weights=np.repeat(pull, lengths) * x, minlength=len(w))
                slope[-1] += pull.sum()
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tobytes()], pa.binary())], names=["value", "slope"])

        parts = learn.select("y", "numbers", "values").mapInArrow(work, "value double, slope binary").collect()  # sixteen at most
        shared.unpersist()
        free = np.append(w[:-1], 0)
        return sum(r["value"] for r in parts) + ridge / 2 * float(free @ free), np.sum([np.frombuffer(r["slope"]) for r in parts], 0) + ridge * free

    w = minimised(loss, np.zeros((1 << BITS) + 1))
    model = Model(w[:-1].astype(np.float32))
    shared = context.broadcast(w)

    @lean
    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, where = shared.value[b.column("numbers").flatten().to_numpy()] * b.column("values").flatten().to_numpy(), np.append(0, np.cumsum(b.column("numbers").value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(per_text(x.astype(np.float64), where))], names=["y", "z"])

    apart = table.filter("calibrates") if all(got.get((True, y), 0) for y in (0, 1)) else table
    pairs = apart.select("y", "numbers", "values").mapInArrow(margin, "y int, z double").toArrow()
    y = pairs.column("y").to_numpy()
    model.slope, model.bias = sigmoid(pairs.column("z").to_numpy(), y, np.where(y == 1, sizes[1] / seen[1], sizes[0] / seen[0]))
    return model


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.slope, model.bias))  # half a megabyte

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for a, z, data, offsets in text_chunks(batch.column(1), CHUNK):
                texts = Texts(data, offsets)
                counts = texts.counts()
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                probability = own.probabilities(own.margins(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(probability), pa.array(~failed & (probability >= keep))], names=["id", *COUNTS, "base_failed", "probability", "kept"])

    schema = "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean"
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
