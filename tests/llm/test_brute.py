"""Language identification and toxicity against plain versions, a text at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from cloudloom.llm import language_id, toxicity

DOCS = "doc_id long, text string, lang string"


def slots(text, dimensions):
    """Counts of a text's hashed n-grams: bytes of words, a blank in place of each other byte."""
    low = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    low = [b if b >= 128 or 97 <= b <= 122 else 0 for b in low]
    out = Counter()
    for size in (1, 2, 3):
        for i in range(len(low) - size + 1):
            own = low[i : i + size]
            if own[1] if size == 3 else any(own):
                gram = sum(b << 8 * (size - 1 - j) for j, b in enumerate(own))
                out[((gram * 4 + size) * 0x9E3779B1 % 2**32) >> (32 - dimensions.bit_length() + 1)] += 1
    return out


def plain_language(text, model):
    """(languages of the nearest centroids, cosine, rejected) of one text."""
    if not any(c.isalpha() for c in text or ""):
        return {"und"}, 0.0, True
    counts = slots(text, len(model.idf))
    v = {s: math.log1p(n) * float(model.idf[s]) for s, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    cosines = [sum(x * float(c[s]) for s, x in v.items()) / norm for c in model.centroids]
    top = max(cosines)
    floor = model.floors[min(max(0, math.ceil(math.log2(len(counts))) - 1), len(model.floors) - 1)]
    return {lang for lang, c in zip(model.languages, cosines) if c > top - 1e-5}, min(1.0, max(0.0, top)), top < language_id.MARGIN * floor


def test_language_equals_a_plain_version(spark):
    r = random.Random(8)
    kinds = {"aa": "kala mola suna Rito".split(), "bb": "strof GRIBST plunk versch".split(), "cc": "été çava où naïf".split(), "dd": "東京 大阪 の は".split()}
    text = lambda k, n: "".join(r.choice(kinds[k]) + r.choice([" ", ", ", "-", "\n", " 12 "]) for _ in range(n))
    rows = [(i, text(k, r.randrange(1, 40)), k) for i, k in enumerate(r.choice(list(kinds)) for _ in range(240))]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), sample_rows=100)
    df = Counter(s for _, t, _ in rows for s in slots(t, len(model.idf)))
    assert np.allclose(model.idf, [math.log((1 + len(rows)) / (1 + df[s])) + 1 for s in range(len(model.idf))], atol=1e-5)  # counts of all rows, not of the sample
    odd = ["", None, "123 -- !", "a", "Z", "é", "東", "kala strof été 東京 " * 50, "qqq xxx jjj", " kala", "x" * 100_000, text("aa", 30_000)]
    probes = rows + [(1000 + i, t, None) for i, t in enumerate(odd)]
    got = {x["doc_id"]: x for x in language_id.predict(spark.createDataFrame(probes, DOCS), model).collect()}
    assert len(got) == len(probes)
    for i, t, _ in probes:
        langs, cosine, rejected = plain_language(t, model)
        assert got[i]["lang_pred"] in langs and abs(got[i]["score"] - cosine) < 1e-4, t and t[:40]
        assert got[i]["rejected"] == rejected, t and t[:40]


def test_toxicity_equals_a_plain_version(spark):
    r = random.Random(9)
    clean, bad = "house tree walk reading garden sun tram letter blumen".split(), "grunk snarvel blorted blorting blorter blorts".split()
    rows = []
    for i in range(600):
        words = [r.choice(clean) for _ in range(r.randrange(5, 60))] + [r.choice(bad) for _ in range(3 if i % 3 == 0 else 0)]
        r.shuffle(words)
        rows.append((i, "".join(r.choice([w, w.upper(), w.title()]) + r.choice([" ", ", ", ".\n", "_", " 7"]) for w in words), None))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)], "doc_id long, toxic int"))
    assert "grunk" in model.terms and any("*" in t for t in model.terms)
    odd = ["", None, "grunk", "ungrunk grunks", "blorted", "blorted blorting", "blorted, blorting; blorter", "grunk1 2grunk", "GRUNK_snarvel", "house " * 20_000 + "grunk", "blort blort"]
    probes = rows + [(1000 + i, t, None) for i, t in enumerate(odd)]
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.score(spark.createDataFrame(probes, DOCS), model).collect()}
    for i, t, _ in probes:
        held = toxicity.terms(t or "")
        own = [w for term, w in zip(model.terms, model.weights) if term in held]
        z = model.bias + sum(own) + (model.weights[-1] if own else 0)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9, t and t[:40]
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in range(500, 600)) >= 98  # rows without a label
