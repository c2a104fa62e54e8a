"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

Voters are a lexicon of words and patterns of stems that stand out in labelled toxic texts. A stem's pattern is that a text holds
several different words that begin with it, so a stem that stands for one word alone never votes. The label model (EM over a
latent class) estimates from the votes alone how often each voter fires in either class, and from the residuals how
voters correlate; correlated voters share their weight. A logistic regression on the votes is then fitted to
the posterior labels, and scores every whole text.

Edge cases: a null or empty text has no votes and gets the score of a text without votes; null labels and labels of unknown
rows teach nothing; several labels of one id count once, as the largest, and of several texts of a labelled id the smallest is
learned from; repeated rows are scored each; without any toxic label no voter exists and every score is 0; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, lean, small_batches

#: Bounds of the fitted sample, documented: labelled rows of each class, by a hash of their id; voters.
SAMPLE_ROWS, VOTERS = 8000, 400
STEMS, DIFFERENT = range(3, 9), (2, 3, 4)  # letters of a stem; different words under it that a pattern asks for
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Whole words (`word`) of a text, and stems with the least number of different words under them (`stem*2`)."""
    words = set(_WORD.findall(text.lower()))
    out = {w for w in words if 3 <= len(w) <= 40}
    for n in STEMS:
        for stem, found in Counter(w[:n] for w in words if len(w) > n).items():
            out |= {f"{stem}*{k}" for k in DIFFERENT if found >= k}
    return out


class Voters:
    """Finds which terms a text holds: one automaton pass, then the word's borders are looked at."""

    def __init__(self, terms_: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[tuple[int, int]]] = {}
        for j, t in enumerate(terms_):
            key, _, different = t.partition("*")
            by.setdefault(key, []).append((j, int(different or 0)))
        for key, votes in by.items():
            self.automaton.add_word(key, (len(key), votes))
        if by:
            self.automaton.make_automaton()
        self.any = bool(by)

    def votes(self, text: str | None) -> set[int]:
        """The terms that the text holds."""
        found: set[int] = set()
        if not text or not self.any:
            return found
        low, under = text.lower(), {}
        for end, (n, votes) in self.automaton.iter(low):
            if end >= n and low[end - n].isalpha():
                continue
            if end + 1 < len(low) and low[end + 1].isalpha():
                if any(k for _, k in votes):
                    key = low[end - n + 1 : end + 1]
                    under.setdefault(key, (votes, set()))[1].add(_WORD.match(low, end - n + 1).group())
            else:
                found.update(j for j, k in votes if not k)
        for votes, words in under.values():
            found.update(j for j, k in votes if k and len(words) >= k)
        return found


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = -50.0
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50, pseudo: float = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, accuracies, residual correlations) of voters that vote 1 or abstain.

    One more voter, the last, votes 0 where all others abstain. A voter's vote counts by its accuracy, which EM estimates
    from the posteriors of the rows it voted on (start: accuracies to begin with, the last voter's too, as so many pseudo-rows), and is
    divided by the sum of its correlations with the others given the class.
    """
    v = votes.astype(float)
    silent = (~v.any(1)).astype(float)
    start = np.clip(start, 0.02, 0.995)
    accuracy, quiet, corr, q = start[:-1], start[-1], np.eye(v.shape[1]), v.any(1).astype(float)
    for _ in range(rounds):
        strong = np.abs(corr)
        share = 1 / np.maximum(1.0, np.where(strong > 0.2, strong, 0).sum(0))
        logit = v @ (share * np.log(accuracy / (1 - accuracy))) - silent * np.log(quiet / (1 - quiet))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - q).max(initial=0) < 1e-6
        q = new
        if done:
            break
        accuracy = np.clip((v.T @ q + pseudo * start[:-1]) / (v.sum(0) + pseudo), 0.02, 0.995)
        quiet = np.clip((silent @ (1 - q) + pseudo * start[-1]) / (silent.sum() + pseudo), 0.5, 0.995)
        rate1, rate0 = (v.T @ q + 0.5) / (q.sum() + 1), (v.T @ (1 - q) + 0.05) / ((1 - q).sum() + 1)
        residual = v - np.outer(q, rate1) - np.outer(1 - q, rate0)
        scale = np.sqrt((residual**2).mean(0)) + 1e-9
        corr = (residual.T @ residual) / len(v) / np.outer(scale, scale)
    return q, np.append(accuracy, quiet), corr


def covering(votes: np.ndarray, toxic: np.ndarray, terms_: list[str], least: int) -> list[int]:
    """Voters of terms that explain toxic rows which no other voter explains, and of their longer and shorter forms.

    Greedy: the term that covers most toxic rows not covered yet, while it covers at least `least`. Words that merely
    stand beside a lexicon's words (in copies of one text, say) cover nothing new. Terms in a twentieth of the toxic
    rows are voters in any case.
    """
    left = votes[toxic].astype(bool)
    chosen = [t for t, n in zip(terms_, left.sum(0)) if n >= max(least, 0.05 * len(left))]
    while left.size:
        gain = left.sum(0)
        j = max(range(len(terms_)), key=lambda j: (gain[j], -len(terms_[j]), terms_[j]))
        if gain[j] < least:
            break
        chosen.append(terms_[j])
        left = left[~left[:, j]]
    stem = lambda t: t.partition("*")[0]
    stems = [stem(c) for c in chosen]
    return [j for j, t in enumerate(terms_) if any(stem(t).startswith(c) or c.startswith(stem(t)) for c in stems)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression to soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, voters: int = VOTERS, support: int = 3, purity: float = 0.9, impure: float = 0.01, common: float = 0.01, chance: float = 0.2) -> Model:
    """A model from docs and labels(id_col, label_col); of each class at most sample_rows rows are looked at.

    A term becomes a voter with at least `support` toxic rows, a smoothed purity, at most `impure` clean rows for each toxic one, a share `common` of the toxic rows, and so many toxic rows that of all
    terms seen at most `chance` would be expected to reach them at the sample's base rate.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    sample = None
    for y in (0, 1):
        own = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        sample = own if sample is None else sample.unionByName(own)
    # at most 2 * sample_rows ids and labels: a proven bound, so they go to every executor
    sampled = sample.collect()
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in sampled], known.schema)
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = cut_lineage(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"))  # one text an id: the bound holds

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter(), Counter()]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                found[1 if y else 0].update(terms(text or ""))
        toxic = found[1]
        clean = [(t, n) for t, n in found[0].items()]
        yield pa.RecordBatch.from_arrays([pa.array([*toxic, *(t for t, _ in clean)], pa.string()), pa.array([*toxic.values(), *[0] * len(clean)], pa.int64()), pa.array([*[0] * len(toxic), *(n for _, n in clean)], pa.int64())], names=["term", "toxic", "clean"])

    counts = cut_lineage(rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    sizes = Counter(r["y"] for r in sampled)
    base = sizes[1] / max(1, len(sampled))
    least = max(support, math.ceil(common * sizes[1]), math.ceil(math.log(max(1, counts.count()) / chance) / -math.log(base))) if 0 < base < 1 else support
    good = (F.col("toxic") >= least) & (F.col("clean") <= impure * F.col("toxic")) & (F.col("toxic") + 0.5 >= purity * (F.col("toxic") + F.col("clean") + 1))
    mined = counts.filter(good).orderBy(F.col("toxic").desc(), "term").limit(voters).collect()
    chosen = [r["term"] for r in mined]
    if not chosen:
        return Model()

    @lean
    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Voters(chosen)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(finder.votes(t)) for t in b.column("text").to_pylist()], pa.list_(pa.int32())), b.column("y")], names=["votes", "y"])

    hits = rows.select("text", "y").mapInArrow(cast, "votes array<int>, y int").collect()  # at most 2 * sample_rows short lists
    v = np.zeros((len(hits), len(chosen)), np.float32)
    for i, own in enumerate(hits):
        v[i, own["votes"]] = 1
    y = np.array([r["y"] for r in hits])
    kept = covering(v, y == 1, chosen, max(2, math.ceil(0.002 * sizes[1])))
    chosen, mined, v = [chosen[j] for j in kept], [mined[j] for j in kept], v[:, kept]
    silent = ~v.any(1)
    start = [(r["toxic"] + 1) / (r["toxic"] + r["clean"] + 2) for r in mined] + [((y[silent] == 0).sum() + 1) / (silent.sum() + 2)]
    q, accuracy, corr = label_model(v, np.array(start))
    weights, bias = logistic(np.column_stack([v, v.any(1)]), q)  # the last weight: of any vote at all
    return Model(chosen, weights, bias, accuracy, corr)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1), which replaces a column of that name: each whole text's votes under the linear classifier."""
    columns = [c for c in docs.columns if c != "toxicity"]

    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Voters(model.terms)
        for b in batches:
            out = []
            for text in b.column(at):
                text = text.as_py()
                found = finder.votes(text)
                z = model.bias + sum(model.weights[j] for j in found) + (model.weights[-1] if found else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "its score"])

    keep = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    at = columns.index(text_col)
    rows = small_batches(docs).select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    judged = rows.mapInArrow(judge, f"{fields}, `its score` double")
    return judged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("`its score`").alias("toxicity"))
