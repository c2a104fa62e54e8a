"""Quality rules: counts against a plain version, the classifier on planted and held-out rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import quality
from cloudloom.llm.common import table
from cloudloom.llm.labels import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counts of one text, in the words of their definitions."""
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


def texts():
    r = random.Random(4)
    word = lambda: r.choice(["a", "b", "çé", "東京", "x#y", "$", "<b>", "🙂", "long-word"])
    out = [None, "", " \t\n", "one", "a\na\n\n \na ", "é " * 19, "é " * 20, "same line\nsame line\r\nsame line\n" * 3, "w " * 50, "\x00\x1c \x0b\x0c ", " nbsp is no space　here " * 3]
    for _ in range(60):
        line = " ".join(word() for _ in range(r.randrange(1, 12)))
        out.append("".join(r.choice([line, word(), " ".join(word() for _ in range(9))]) + r.choice([" ", "\n", "\n\n", "\t", " \n"]) for _ in range(r.randrange(30))))
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 50])
def test_counts_against_their_definitions(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    rows = [*enumerate(texts()), (None, "a null id"), (1, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "n_words", "kept", "probability", "y")}).repartition(3)
    got = quality.judge(df, quality.Model()).collect()
    assert sorted(((r["id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in got), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # without a model the counts decide


def test_a_text_is_judged_alike_wherever_it_stands():
    all_texts = [t or "" for t in texts()]
    model = quality.Model(np.random.default_rng(1).standard_normal(1 << quality.BITS).astype(np.float32), 1.0, 0.0)

    def margins(some):
        raw = [t.encode() for t in some]
        return model.margins(quality.Texts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))))

    together = margins(all_texts)
    assert together.tolist() == [margins([t])[0] for t in all_texts]


def test_planted_junk_and_calibration(spark):
    """Half of the texts of one kind are labelled bad: their probability is near one half, clean ones are kept, junk goes."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "sin", "do", "vel", "pran")]
    clean = lambda: " ".join(r.choice(words) for _ in range(60))
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = clean() if kind == 0 else " ".join(w + r.choice(["###", "$$$"]) for w in clean().split()) if kind == 1 else " ".join(w + "~" for w in clean().split())
        rows.append((i, text))
        labels.append((i, 1 if kind == 0 else 0 if kind == 1 else int(r.random() < 0.5)))
    labels += [(0, None), (None, 1), (5000, 0), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int").filter("doc_id is null or doc_id < 450 or doc_id = 5000"))
    got = {x["id"]: x for x in quality.judge(docs, model).collect()}
    unseen = range(450, 600)
    assert all(got[i]["kept"] for i in unseen if i % 3 == 0) and not any(got[i]["kept"] for i in unseen if i % 3 == 1)
    assert 0.3 < np.mean([got[i]["probability"] for i in unseen if i % 3 == 2]) < 0.7


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b " * 15), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, None), (9, 0)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["id"]: r["probability"] for r in quality.judge(docs, model).collect()} == {1: 1.0, 2: 1.0}
    assert quality.judge(docs.limit(0), quality.Model()).count() == 0


def test_held_out_labels(spark):
    """Of labelled rows that were not learned from, the verdict is the label; short and repetitive rows are failed by counts."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels.filter(fold("doc_id", 3) != 0))
    rows = quality.judge(docs, model).join(labels.filter(fold("doc_id", 3) == 0), F.col("id") == F.col("doc_id")).filter("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows) > 60
