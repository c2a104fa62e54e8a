"""The training-data operators against brute force, round trips and planted cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from cloudloom.llm import decontaminate, html_text, language_id, near_dup, packing, sharding, topk, toxicity, url_filter, warc
from cloudloom.llm.components import connected
from cloudloom.llm.labels import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "red blue green stone river cloud tree house light wind rain fire sand wave hill road lamp door".split()


def text(random_: random.Random, n: int) -> str:
    return " ".join(random_.choice(WORDS) + str(random_.randrange(40)) for _ in range(n))


def odd_docs(spark, more=()):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 3), (4, "A", "en", None, 1), (None, "a b c d e f g", "en", "a", 7), (6, "same text of six words here", "en", "a", 1), (7, "same text of six words here", None, "b", 1), (7, "same text of six words here", None, "b", 1), (8, "x " * 30_000, "de", "a", 1), *more]
    # clashing names of columns that operators make themselves
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("id", "score", "size", "digest", "component", "pred", "c0", "rep", "length", "its text")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 URL filters


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [("http://A.Example.NET/en/1?x", "a.example.net", "/en/1"), (None, "", ""), ("no scheme/x", "", ""), ("https://h.org#f", "h.org", ""), ("x://y://z/p", "y:", "//z/p"), ("ftp://É.ORG/ß", "É.org", "/ß")],
)
def test_split_url(spark, url, host, path):
    h, p = url_filter.split_url(F.col("url"))
    assert tuple(spark.createDataFrame([(url,)], "url string").select(h, p).first()) == (host, path)


def test_rules_and_templates(spark):
    urls = ["http://a.net/x", "http://example.net/en/1", "http://b.example.net/en/", "http://example.com/de/2", "http://x.org/fr/9", "http://x.org/de/9", None, "", "http://internet/x"]
    urls += [f"http://spam.org/s{i}/p" for i in range(6)] + ["http://spam.org/s1/p"]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))).collect()
    by = {r["page_id"]: r for r in rows}
    assert len(rows) == len(urls)
    assert [by[i]["rule"] for i in range(9)] == ["net/", "example.net/en/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert [by[i]["verdict"] for i in range(9)] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
    assert {by[i]["verdict"] for i in range(9, 16)} == {"block"} and {by[i]["template"][:3] for i in range(9, 16)} == {"/*/"}


def test_labelled_branches_speak_for_branches_like_them(spark):
    urls, known = [], []
    for kind, bad, labelled, tail in (("a", 1, 30, ""), ("b", 1, 30, ""), ("c", 1, 0, ""), ("d", 0, 30, "/x/y"), ("e", 0, 30, "/x/y"), ("f", 0, 1, "/x/y")):
        for i in range(60):
            urls.append(f"http://h.org/{kind}/{i}{tail}")
            if i < labelled:
                known.append((urls[-1], bad))
    known += [(urls[0], None), (None, 1), ("http://x.org/", 1)]
    urls += ["http://h.org/g", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels=spark.createDataFrame(known, "url string, bad int")).collect()}
    assert len(rows) == len(urls)
    kinds = {u.split("/")[3]: {rows[i]["verdict"] for i, x in enumerate(urls) if x == u or x and x.startswith(u.rsplit("/", len(u.split("/")) - 4)[0] + "/")} for u in urls[:360]}
    # a and b are known to be bad; c goes on as they do and has no label of its own; d to f are good
    assert kinds == {"a": {"block"}, "b": {"block"}, "c": {"block"}, "d": {"allow"}, "e": {"allow"}, "f": {"allow"}}
    assert {r["template"] for i, r in rows.items() if i < 180} == {"/~1/*"} and rows[200]["template"] == "/~0/*/x/y" and rows[361]["verdict"] == "allow"


def test_words_label_and_templates_decide(spark):
    urls = [f"http://h.org/{w}/story-{chr(97 + i)}/page" for w in ("news", "poker-online") for i in range(20)] + ["http://h.org/news/a-casino-opens/page", "http://h.org/poker-online/rules/page", "http://best-slots.org/", "http://alphabets.org/track1/adsorption", "http://h.org/" + "/".join(f"p{i}" for i in range(12))]
    rows = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {rows[i] for i in range(20)} == {"allow"} and {rows[i] for i in range(20, 40)} == {"block"}
    assert [rows[i] for i in range(40, 45)] == ["allow", "block", "block", "block", "allow"]


def test_url_filter_on_no_rows(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


# 2 toxicity


def test_toxicity_learns_planted_words(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = text(r, 60).split()
        if bad:
            for _ in range(2):
                words.insert(r.randrange(60), r.choice(["vilkor", "grundelo" + r.choice(["na", "ti", "mo"])]))
        rows.append((i, " ".join(words), "en", "s", 1))
        if i < 400:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(600))
    assert {r["toxicity"] < 0.5 for r in toxicity.score(odd_docs(spark), model).collect()} == {True}
    assert toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int")).terms == []
    assert toxicity.score(empty(spark), model).collect() == []


SENTENCES = ["The train stops at a clock tower.", "We discuss trade, close the path and move on.", "Each worth a look tomorrow morning.", "The distant mountain path was closed to trade for more than a month.", "Our class cloned the morning's display of idiomatic clocks.", "El tren se detiene cerca de la torre del reloj y el bosque.", "Der Zug hält jeden Morgen am alten Uhrturm, achtlos und ruhig.", "Le train s'arrête près de la réunion des réeux et des réseaux.", "Losers of the first round may discuss the losses with a scribe.", "Stupendous scenery, and a moral tale of trash collectors' wages."]


def test_toxicity_on_held_out_rows_and_clean_sentences(spark):
    """Nine of ten labelled toxic rows that were not learned from are found, one clean row in a hundred is taken at most; everyday sentences are left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    rows = toxicity.score(docs.join(labels.filter(fold("doc_id", 5) == 0), "doc_id"), model).collect()
    toxic, clean = ([r["toxicity"] >= 0.5 for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) > 80 and sum(clean) <= 0.01 * len(clean)
    scored = toxicity.score(spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["toxicity"] >= 0.5 for r in scored} == {i: i == 9 for i in range(10)}  # the last one does hold a listed word
    assert all(int(t.partition("*")[2]) > 1 for t in model.terms if "*" in t)  # no stem for one word


def test_votes_are_those_of_the_terms_of_a_text():
    r = random.Random(2)
    texts = [" ".join(r.choice(["Ach", "achlich", "achlicher", "ACHLICHTE", "bo", "bosco", "x1achlichte", "boßte"]) + r.choice(["", ",", "-x", "1"]) for _ in range(r.randrange(12))) for _ in range(200)]
    every = sorted({t for x in texts for t in toxicity.terms(x)})
    finder = toxicity.Voters(every)
    assert all({every[j] for j in finder.votes(x)} == toxicity.terms(x) for x in texts) and any("*3" in t for t in every)
    assert finder.votes(None) == finder.votes("") == toxicity.Voters([]).votes("achlich") == set()


# 3 near duplicates


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(sets, num, den):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("small", [4000, 5])  # a candidate component in one task, and in block pairs
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL_DOCS", small)
    r = random.Random(2)
    rows = []
    for i in range(30):
        base = text(r, r.choice([3, 5, 20, 80]))
        rows.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w = base.split()
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "q" + str(r.randrange(99))
            rows.append(" ".join(w) if r.random() < 0.8 else base)
    rows = list(enumerate(rows))
    got = {x["id"]: (x["n"], x["component"]) for x in near_dup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), k=3, num=85).collect()}
    sets = sets_of(rows, 3)
    want = brute_components(sets, 85, 100)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((x["id"], x["n"], x["component"]) for x in near_dup.near_duplicates(odd_docs(spark), k=5).collect()), key=str)
    assert (None, 3, None) in got and (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (4, 1, 4) in got and (8, 1, 8) in got
    assert got.count((7, 2, 6)) == 2 and (6, 2, 6) in got
    assert near_dup.near_duplicates(empty(spark)).collect() == []


def test_repeated_rows_and_ids(spark, monkeypatch):
    r = random.Random(13)
    base = text(r, 60)
    near = " ".join(base.split()[:-1] + ["other"])
    rows = [(5, base)] * 300 + [(9, near)] * 200 + [(3, text(r, 40)), (3, base), (2, text(r, 50))] + [(None, base)] * 3
    got = sorted(((x["id"], x["n"], x["component"]) for x in near_dup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), k=3, num=85).collect()), key=str)
    assert got == sorted([(5, 58, 3)] * 300 + [(9, 58, 3)] * 200 + [(3, 38, 3), (3, 58, 3), (2, 48, 2)] + [(None, 58, None)] * 3, key=str)


@pytest.mark.parametrize("kind", ["linked", "unlinked"])
def test_a_crowd_of_one_passage_in_many_blocks_and_windows(spark, monkeypatch, kind):
    for name, value in (("SMALL_DOCS", 20), ("WINDOW", 32), ("SHARED", 3)):
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(14)
    passage = text(r, 120).split()
    rows = []
    for i in range(300):
        w = passage[:]
        for _ in range(r.randrange(12) if kind == "linked" else 9):
            w[r.randrange(120)] = f"z{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    got = {x["id"]: x["component"] for x in near_dup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), k=3, num=85).collect()}
    want = brute_components(sets_of(rows, 3), 85, 100)
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 0.02 * len(want)


def test_connected_with_hubs(spark, monkeypatch):
    from cloudloom.llm import components

    monkeypatch.setattr(components, "HOT", 5)
    monkeypatch.setattr(components, "TASK_EDGES", 100)  # rounds of stars, with hubs joined apart
    r = random.Random(15)
    edges = [(1, i) for i in range(2, 200)] + [(900, i) for i in range(500, 900)] + [(900, 1000), (1000, 1001), (199, 300)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(250)]
    edges = [(u, v) for u, v in edges if u != v]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    got = connected(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert len(got) == len(up) and {x["node"]: x["component"] for x in got} == {x: find(x) for x in up}


def test_connected_chain(spark):
    edges = [(i + 1, i) for i in range(100)] + [(300, 200), (200, 300), (250, 300)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 250: 200, 300: 200}


# 4 decontamination


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(3)
    items = [(i, text(r, r.choice([8, 12, 16, 30, 55]))) for i in range(12)]
    rows, want = [], set()
    for d in range(60):
        w = text(r, 150).split()
        if d % 2:
            i, t = items[d % 12]
            own = t.split()
            for _ in range(int(0.2 * len(own)) if d % 4 == 1 else 0):
                own[r.randrange(len(own))] = "edited"
            at = r.randrange(len(w))
            w[at:at] = own
            want.add((d, i))
        rows.append((d, " ".join(w).upper() if d % 3 == 0 else " ".join(w), "en", "s", 1))
    docs, benchmark = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert {(x["id"], x["item"]) for x in found} == want
    kept = {x["doc_id"] for x in decontaminate.without_leaks(docs, benchmark).collect()}
    assert kept == {d for d in range(60) if d % 2 == 0}
    assert decontaminate.find_leaks(odd_docs(spark), benchmark).collect() == []
    assert decontaminate.without_leaks(odd_docs(spark), benchmark).count() == 9
    assert decontaminate.without_leaks(empty(spark), benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("length", [8, 10, 12, 16, 17, 20, 25, 30, 31, 45])
def test_recall_of_every_length_at_the_full_edit_rate(length):
    r = random.Random(length)
    word = lambda kind: f"{kind}{r.randrange(50_000)}"
    plain = [[word("w") for _ in range(length)] for _ in range(400)]
    items = decontaminate.prepare([(i, " ".join(x)) for i, x in enumerate(plain)])
    docs = []
    for own in map(list, plain):
        for at in sorted(r.sample(range(length), int(0.2 * length)), reverse=True):
            own[at : at + 1] = r.choice([[word("e")], [own[at], word("e")], []])
        docs.append(" ".join([*(word("w") for _ in range(40)), *own, *(word("w") for _ in range(40))]))
    found = set()
    for first, _, words, where in decontaminate.words_of(pa.array(docs)):
        found |= {(first + d, own) for d, i, *_ in decontaminate.leaks_in(words, where, items) for own in items.ids[i]}
    assert sum((i, i) in found for i in range(400)) >= 0.98 * 400


def leaks(texts, items):
    return {(first + d, own): x for first, _, words, where in decontaminate.words_of(pa.array(texts)) for d, i, *x in decontaminate.leaks_in(words, where, items) for own in items.ids[i]}


def test_unedited_items_are_found_next_to_parts_of_others():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(400)}"
    plain = [[word() for _ in range(r.choice([8, 15, 25, 40, 59]))] for _ in range(150)]
    plain += [x[:] for x in plain[:5]]  # equal items
    items = decontaminate.prepare([(i, " ".join(x)) for i, x in enumerate(plain)])
    docs = [plain[(i + 7) % 150][len(plain[(i + 7) % 150]) // 2 :] + plain[i] + plain[(i + 3) % 150][: r.randrange(1, 8)] for i in range(155)]
    found = leaks([" ".join(x) for x in docs], items)
    assert all(found[i, i][0] == 0 for i in range(155))
    assert all(found[i, 150 + i][0] == 0 for i in range(5))
    for (d, i), (edits, a, z) in found.items():
        assert edits == decontaminate.fitting(*(np.array([hash(w) for w in x]) for x in (plain[i], docs[d])))[0] <= 0.2 * len(plain[i])


def test_items_against_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 700)  # several passes
    r = random.Random(12)
    items = [(i, text(r, r.choice([3, 5, 6, 7, 9, 14, 22, 35]))) for i in range(30)]
    rows = []
    for d in range(80):
        w = text(r, r.randrange(0, 60)).split()
        for _ in range(r.randrange(3)):
            own = r.choice(items)[1].split()
            for _ in range(r.randrange(1 + int(0.3 * len(own)))):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([["edit"], [own[at], "more"], []])
            at = r.randrange(len(w) + 1)
            w[at:at] = own
        rows.append((d, " ".join(w), "en", "s", 1))
    want = {}
    for d, t, *_ in rows:
        for i, own in items:
            a, b = own.split(), t.split()
            edits = decontaminate.fitting(*(np.array([hash(w) for w in x], np.int64) for x in (a, b)))[0]
            if edits <= int(0.2 * len(a)):
                want[d, i] = (edits, len(a))
    got = {(x["id"], x["item"]): (x["edits"], x["words"]) for x in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*items, (50, None)], "item_id long, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and all(want[x] == got[x] for x in got) and len(want) > 40


@pytest.mark.parametrize("rate", [0.2, 0.4])
def test_no_edited_short_item_is_missed(rate):
    """Items of 1 to 7 words with every edit that the rate allows, among words that many items share, at the edges of documents too."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(12)}"
    plain = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 6, 6, 7, 7) for _ in range(4)]
    docs = []
    for own in plain * 3:
        own = own[:]
        for _ in range(r.randrange(1 + int(rate * len(own)))):
            at = r.randrange(len(own) + 1)
            own[at : at + 1] = r.choice([["x"], [*own[at : at + 1], "x"], [], ["x", *own[at : at + 1]]])
        docs.append([*(word() for _ in range(r.choice([0, 0, 3, 9]))), *own, *(word() for _ in range(r.choice([0, 0, 3, 9])))])
    items = decontaminate.prepare([(i, " ".join(x)) for i, x in enumerate(plain)], rate)
    found = leaks([" ".join(x) for x in docs], items)
    want = {}
    for d, t in enumerate(docs):
        for i, own in enumerate(plain):
            edits = decontaminate.fitting(*(np.array([hash(w) for w in x], np.int64) for x in (own, t)))[0]
            if edits <= int(rate * len(own)):
                want[d, i] = edits
    assert {k: v[0] for k, v in found.items()} == want and len({v for v in want.values()}) > 1
    for (d, i), (edits, a, z) in found.items():
        assert decontaminate.fitting(*(np.array([hash(w) for w in x], np.int64) for x in (plain[i], docs[d][a:z])))[0] == edits


def test_short_items_are_found_exactly(spark):
    docs = spark.createDataFrame([(1, "a b c. D e", "en", "s", 1), (2, "c d", "en", "s", 1), (3, "e f x a", "en", "s", 1), (4, "a b x c d e f", "en", "s", 1), (5, "C, d! a b c d", "en", "s", 1), (6, None, "en", "s", 1)], DOCS)
    benchmark = spark.createDataFrame([(1, "c d"), (2, "A b c d"), (3, "c d"), (4, "f"), (5, "?!")], "item_id long, text string")
    got = sorted((x["id"], x["item"], x["edits"], x["words"], x["first_word"], x["last_word"]) for x in decontaminate.find_leaks(docs, benchmark).collect())
    assert got == [(1, 1, 0, 2, 2, 3), (1, 2, 0, 4, 0, 3), (1, 3, 0, 2, 2, 3), (2, 1, 0, 2, 0, 1), (2, 3, 0, 2, 0, 1), (3, 4, 0, 1, 1, 1), (4, 1, 0, 2, 3, 4), (4, 3, 0, 2, 3, 4), (4, 4, 0, 1, 6, 6), (5, 1, 0, 2, 0, 1), (5, 2, 0, 4, 2, 5), (5, 3, 0, 2, 0, 1)]
    assert [x["doc_id"] for x in decontaminate.without_leaks(docs, benchmark).collect()] == [6]


def test_fitting_is_the_edit_distance():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = r.integers(0, 4, r.integers(1, 8)), r.integers(0, 4, r.integers(0, 12))

        def distance(x, y):
            d = list(range(len(y) + 1))
            for i, c in enumerate(x):
                d, prev = [i + 1], d
                for j, e in enumerate(y):
                    d.append(min(prev[j] + (c != e), prev[j + 1] + 1, d[-1] + 1))
            return d[-1]

        assert decontaminate.fitting(a, b)[0] == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


# 5 main text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, please agree.</div><article><h1>A &eacute; B</h1><p><b>One, two.<br><p>Three&nbsp;four;  five <i>six</i>.</p><script>var a="</p>";</script><!-- ad --><div class="ad">Buy now!</div><ul><li>seven</ul></article>
<section class="comments"><p>Nice one, I liked this very much, thanks for it.</p></section><aside>Side</aside><form><p>Name</p></form><footer>&copy; F"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A é B\nOne, two.\nThree four; five six.\nseven"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("only text & more") == "only text & more"
    bare = '<body><div id="menu"><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></div><div class=main><h2>Head</h2><p>A first paragraph, with text; and punctuation.</p><p>Short.</p></div></body>'
    assert html_text.main_text(bare) == "Head\nA first paragraph, with text; and punctuation.\nShort."


def test_ratios_decide_inside_an_article_too():
    p = "<p>A paragraph of some length, with words; and with punctuation, as prose has it.</p>"
    links = "<ul>" + "".join(f"<li><a href={i}>Another story {i}</a></li>" for i in range(9)) + "</ul>"
    cards = "<div>" + "".join(f"<h5>Lamp {i}</h5><span><div>{i} EUR</div></span>" for i in range(9)) + "</div>"
    short = "<ul>" + "".join(f"<li>item {i}</li>" for i in range(9)) + "</ul>"
    for holder in ("article", "main"):
        got = html_text.main_text(f"<body><{holder}><h1>Head</h1>{p * 3}{links}{p}{cards}{p}{short}{p}</{holder}><div>{p}</div></body>")
        assert "Another story" not in got and "Lamp 4" not in got and "4 EUR" not in got
        assert got.startswith("Head\n") and got.count("A paragraph") == 7 and all(f"item {i}" in got for i in range(9))


def test_names_only_weigh():
    p = "<p>A paragraph of some length, with words; and with punctuation, as prose has it.</p>"
    got = html_text.main_text(f'<article><h1>T</h1>{p}<div class="search-results">{p}</div><p class="hidden md:block">Shown on larger screens, as it may be.</p><p hidden>Not shown at all, whatever it says.</p><div style="display:none">Nor this, of course.</div></article>')
    assert got.count("A paragraph") == 2 and "larger screens" in got and "Not shown" not in got and "Nor this" not in got
    whole = f'<form id="aspnet"><div class="page with-sidebar"><nav><a href=1>Home</a><a href=2>About us</a></nav>{p * 3}<div class="comments">{p.replace("A para", "My para")}</div></div></form>'
    assert html_text.main_text(whole).count("A paragraph") == 3 and "My para" not in html_text.main_text(whole) and "Home" not in html_text.main_text(whole)


def test_a_page_without_an_article():
    p = lambda s: f"<p>{s} This is a sentence of the article, which has commas; and it goes on for a while, as prose does.</p>"
    page = f"""<body class="home"><div id="header"><a href="/">Site</a> Tagline of the site</div><ul class="nav"><li><a href=1>One</a><li><a href=2>Two</a></ul>
<div id="wrapper" class="has-sidebar"><div id="content"><h1>Title here</h1><div class="meta">By <a href="/a">Ann</a></div>{p("First.")}<ul><li>short item<li>second item</ul><blockquote><p>Quoted words.</p></blockquote>{p("Second.")}<h2>Sub</h2>{p("Third.")}
<div class="share">Share this: <a href=x>Somewhere</a></div></div><div id="sidebar"><h3>Recent posts</h3><ul><li><a href=1>A long title of some other post, which is here</a></ul><p>About the author, who writes a lot, and likes it; a text of prose with commas.</p></div></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>I really liked this, thank you, it was a good read; and I learned something.</p></div></div><div id="footer">Copyright 2020, all rights reserved. Some long text in the footer, with commas, and more.</div>"""
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title here" and [x.split(".")[0] for x in lines if "sentence" in x] == ["First", "Second", "Third"]
    assert {"short item", "second item", "Quoted words.", "Sub"} <= set(lines) and len(lines) <= 9
    assert not any(w in x for x in lines for w in ("Tagline", "Share", "Recent", "author", "liked", "comments", "Copyright", "One"))
    long = page.replace('<div class="comment">', '<div class="comment">' + "<p>Another remark of a reader, which is long, and has commas; more so than the article.</p>" * 20)
    assert "remark" not in html_text.main_text(long)


def test_structure_decides_where_names_say_nothing():
    p = lambda s: f"<p>{s} This is a sentence of the article, which has commas; and it goes on for a while, as prose does.</p>"
    got = html_text.main_text(f'<article><h1>T</h1><div class="section-header"><p>Intro line of the section.</p></div>{p("First.")}<section id="discussion"><h2>Discussion</h2>{p("Second.")}</section></article>')
    assert "Intro line of the section." in got and "Discussion" in got and "Second." in got
    bare = f'<body><div class="page"><h1>Title</h1>{p("First.")}{p("Second.")}<h2>Steps</h2><ol><li>fill it<li>stir it<li>serve it</ol></div><div id="footer">Copyright, all rights reserved, of this site.</div></body>'
    assert html_text.main_text(bare).split("\n")[-4:] == ["Steps", "fill it", "stir it", "serve it"]
    remark = "<div><b class=who>{}</b><div>Reader {}, today</div><p>I read this with joy, thank you; it was good, and I learned a lot from it.</p></div>"
    remarks = "".join(remark.format(x, x) for x in ("Ann", "Bob", "Cy"))
    article = f"<article><h1>T</h1>{p('First.')}{p('Second.')}</article>"
    for after in (f'<ol class="commentlist"><li>{p("Mine.")}<li>{p("Mine.")}</ol>', f'<section id="discussion">{p("Mine.")}</section>', f'<div id="gdprbox">{p("Mine.")}</div>', f'<div id="x">{remarks}</div>'):
        got = html_text.main_text(f"<body>{article}{after}</body>")
        assert got.count("This is a sentence") == 2 and "Mine" not in got and "joy" not in got, after
    more = f"<div><h2>On</h2>{p('Third.')}<h2>And on</h2>{p('Fourth.')}</div>"  # prose after an article is kept
    assert html_text.main_text(f"<body>{article}{more}</body>").count("This is a sentence") == 4
    items = f"<div>{p('Third.')}<ul><li>one<li>two</ul>{p('Fourth.')}<ul><li>three<li>four</ul>{p('Fifth.')}</div>"
    assert html_text.main_text(f"<body>{article}{items}</body>").count("This is a sentence") == 5


def test_open_elements_are_closed_as_browsers_do():
    texts = lambda page: [(x.text, x.path) for x in html_text.nodes(page)]
    same = [("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"), ("<p>a<b>b<p>c<div>d</div>", "<p>a<b>b</b></p><p>c</p><div>d</div>"), ("<table><tr><td>a<td>b<tr><th>c</table>e", "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>e"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<div>a</span></i>b</p>c</div>d", "<div>abc</div>d")]
    for loose, strict in same:
        assert [x for x, _ in texts(loose)] == [x for x, _ in texts(strict)] or "".join(x for x, _ in texts(loose)) == "".join(x for x, _ in texts(strict))
        assert len({p for _, p in texts(loose)}) == len({p for _, p in texts(strict)})
    assert [x for x, _ in texts("a<b title=\"1 > 2\">c</b><i x='>'>d</i><a t=it's>e</a> 3 < 4 <")] == ["a", "c", "d", "e", " 3 < 4 <"]
    assert [x for x, _ in texts("<script>x</script >a<title>b</title>c<style>d")] == ["a", "c"]


@pytest.mark.parametrize("page", ["<b></i>" * 140_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 200_000, "<b " * 300_000 + '"', '<b x="' * 150_000, "<div>" * 100_000 + "<li>" * 100_000, "<p><c-x>" + "<b>" * 100_000 + "<div></div>" * 30_000, "<script>" + "</script " * 100_000, "<a" * 400_000 + ">", "<!--" * 200_000, "<table>" + "<tr><td>x" * 60_000, "<a b=\"" * 90_000 + "<a b='" * 90_000])
def test_hostile_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10


def test_extract_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, ""), (3, "u", "x" * 300_000)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("main_text", "its html", "text", "path")})
    rows = html_text.extract(pages.drop("main_text")).collect()
    assert sorted((x["main_text"][:5] for x in rows)) == ["", "A é B"[:5], "A é B"[:5], "xxxxx"]
    assert html_text.extract(pages.drop("main_text").limit(0)).collect() == []


def test_extract_keeps_columns(spark):
    rows = html_text.extract(spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumn("c0", F.lit(1)))
    assert rows.columns == ["page_id", "url", "c0", "main_text"] and [r["main_text"] for r in rows.orderBy("page_id").collect()][1] == ""


# 6 top-k


@pytest.mark.parametrize("chunk", [4096, 40])
def test_topk_against_all_products(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "LEAF", 16)
    r = np.random.default_rng(4)
    v = [(i, [float(x) for x in r.normal(size=6)]) for i in range(150)] + [(200, [0.5] * 6), (201, [0.5] * 6), (220, [0.5] * 6)]
    odd = [(300, None), (320, []), (340, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (360, [float("nan")] * 6), (380, [float("inf")] * 6), (400, [1.0, 2.0])]
    got = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in topk.top_k(spark.createDataFrame(v + odd, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 7).collect()}
    q = {i: np.floor(64 * np.array(x)).astype(int) for i, x in v}
    want = {}
    for i in q:
        if i % 20 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:7]
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want


def test_topk_of_repeated_ids_huge_values_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2e13, 0.0]), (2, [3.0, 1.0]), (20, [5.0, 5.0]), (20, [5.0, 5.0]), (None, [9.0, 9.0]), (40, [1e300, 1.0]), (7, [4.0])]
    pages = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "row", "v", "dim", "score", "chunk", "floor")})
    got = defaultdict(list)
    for x in sorted(topk.top_k(pages, F.col("id") % 20 == 0, 3).collect(), key=lambda x: (x["query_row"], x["rank"])):
        got[x["query_id"], x["query_row"]].append((x["id"], x["score"]))
    assert sorted((i, v) for (i, _), v in got.items() if i < 40) == [
        (0, [(40, 2**63 - 1), (1, 64 * 64 * 20_000_000_000_000), (20, 20480)]),
        *[(20, [(40, 2**63 - 1), (1, 5 * 64 * 64 * 20_000_000_000_000), (20, 2 * 320 * 320)])] * 2,
    ]
    assert topk.top_k(pages.limit(0), F.col("id") % 20 == 0).collect() == []


@pytest.mark.parametrize("equal", [False, True])
def test_topk_of_clusters_in_many_blocks(spark, monkeypatch, equal):
    for name, value in (("CHUNK", 64), ("BLOCK", 8), ("LEAF", 8), ("FANOUT", 3), ("PIVOTS", 4)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(5)
    centres = r.normal(size=(5, 4)) * 3
    v = np.round(centres[r.integers(0, 5, 400)] + (0 if equal else 0.05) * r.normal(size=(400, 4)), 3)
    rows = [(int(i), [float(c) for c in x]) for i, x in enumerate(v)]
    got = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 4 == 0, 6).collect()}
    q = np.floor(64 * v).astype(int)
    assert got == {(i, n + 1): (j, -s) for i in range(0, 400, 4) for n, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:6])}


# 7 sharding


def test_shards(spark):
    r = random.Random(5)
    rows = [(i, text(r, r.randrange(1, 60)) if i % 9 else "copy " * 20, "en", "s", 1) for i in range(800)]
    got = sharding.assign_shards(odd_docs(spark, rows), 16).collect()
    assert len(got) == 809
    size, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in got:
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    small = sharding.assign_shards(spark.createDataFrame(rows, DOCS), 16).collect()
    size = defaultdict(int)
    for x in small:
        size[x["shard"]] += x["size"]
        groups[x["digest"]].add(x["shard"])
    mean = sum(size.values()) / 16
    assert all(abs(s - mean) < 0.2 * mean for s in size.values()) and set(size) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty(spark), 16).collect() == []
    texts = {i: t for i, t, *_ in rows}
    assert all(x["crc"] == zlib.crc32(texts[x["id"]].encode()) and x["size"] == len(texts[x["id"]].encode()) + 1 for x in small)


def cut_by_hand(rows, shards, slack):
    """The law on a sorted list: equal byte targets, a cut at the edge of an equal text's group where that is near enough."""
    rows = sorted(rows, key=lambda x: (hashlib.md5(x[1].encode()).hexdigest(), x[0]))
    ends = np.cumsum([len(t.encode()) + 1 for _, t in rows])
    total, largest = int(ends[-1]), max(len(t.encode()) + 1 for _, t in rows)
    starts, out = [0, *ends[:-1].tolist()], []
    for i in range(1, shards):
        t = total * i // shards
        k = next(j for j in range(len(rows)) if starts[j] <= t < ends[j])
        own = [j for j in range(len(rows)) if rows[j][1] == rows[k][1]]
        best = min([(starts[own[0]], own[0]), (int(ends[own[-1]]), own[-1] + 1)], key=lambda e: (abs(e[0] - t), e[0]))
        if abs(best[0] - t) > max(slack * total / shards, largest):
            best = min([(starts[k], k), (int(ends[k]), k + 1)], key=lambda e: (abs(e[0] - t), e[0]))
        out.append(best[1])
    return {(i, j): (sum(j >= c for c in out), j - max([0, *(c for c in out if c <= j)])) for j, (i, _) in enumerate(rows)}


def test_shards_against_a_sorted_list(spark):
    r = random.Random(21)
    rows = [(i, text(r, r.randrange(1, 40)) if i % 3 else ["hot copy " * 30, "warm " * 9][i % 2]) for i in range(900)]
    got = sorted(((x["digest"], x["id"], x["shard"], x["slot"]) for x in sharding.assign_shards(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), 16).collect()))
    want = cut_by_hand(rows, 16, sharding.SLACK)
    assert [x[1:] for x in got] == [(i, *v) for (i, _), v in want.items()]
    size = defaultdict(int)
    for (i, _), (shard, _) in want.items():
        size[shard] += len(dict(rows)[i].encode()) + 1
    groups = defaultdict(set)
    for d, _, shard, _ in got:
        groups[d].add(shard)
    assert len([g for g in groups.values() if len(g) > 1]) <= 2  # the two large groups of equal texts alone are split
    assert max(size.values()) <= 1.1 * sum(size.values()) / 16


def test_a_hot_row_is_split(spark):
    rows = [(1, "same " * 50, "en", "s", 1)] * 3000 + [(i, text(random.Random(i), 30), "en", "s", 1) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["n"] for r in sharding.ordered(spark.createDataFrame(rows, DOCS), "doc_id", "text").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(parts) < 0.6 * len(rows) and sum(parts) == len(rows)


# 8 language


def test_language(spark):
    r = random.Random(6)
    kinds = {"aa": "kala mola suna", "bb": "strof gribst plunk", "cc": "été çava où"}
    rows = [(i, " ".join(r.choice(kinds[k].split()) + r.choice(kinds[k].split()) for _ in range(r.randrange(2, 40))), k, "s", 1) for i, k in enumerate(r.choice(list(kinds)) for _ in range(300))]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(docs.drop("lang"), model).collect()}
    assert sum(got[i] == k for i, _, k, *_ in rows) >= 297
    odd = {x["doc_id"]: x for x in language_id.predict(odd_docs(spark, [(50, "123 456 !", "en", "s", 1)]), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (1, 2, 3, 50))
    none = language_id.predict(docs, language_id.fit(empty(spark)))
    assert {x["lang_pred"] for x in none.collect()} == {"und"}


def test_far_texts_are_rejected_and_short_clean_ones_kept(spark):
    r = random.Random(16)
    kinds = {"aa": ["ka", "lo", "mu", "sa", "ri", "to", "ne"], "bb": ["stro", "grib", "plu", "nkt", "asch", "ver"], "far": ["qwy", "xej", "zzu", "vvy", "wux"]}
    word = lambda k: "".join(r.choice(kinds[k]) for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(r.choice([1, 2, 5, 20, 80, 300]))), k, "s", 1) for i, k in enumerate(r.choice(["aa", "bb"]) for _ in range(900))]
    rows += [(5000 + i, rows[0][1], rows[0][2], "s", 1) for i in range(400)]  # a text of very many rows
    rows += [(6000 + i, " ".join(word("aa") for _ in range(60)), "bb", "s", 1) for i in range(12)]  # labelled wrongly
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs)
    assert set(model.languages) == {"aa", "bb"} and len(model.languages) <= 8
    probes = [(i, " ".join(word(k) for _ in range(n)), k, "s", n) for i, (k, n) in enumerate((k, n) for k in kinds for n in (1, 2, 6, 30, 100) for _ in range(40))]
    got = {x["doc_id"]: x for x in language_id.predict(spark.createDataFrame(probes, DOCS), model).collect()}
    clean, far = [p for p in probes if p[2] != "far"], [p for p in probes if p[2] == "far"]
    assert sum(got[i]["rejected"] for i, *_ in clean) <= 0.01 * len(clean)
    assert sum(got[i]["lang_pred"] == k for i, _, k, *_ in clean) >= 0.99 * len(clean)
    assert all(got[i]["rejected"] for i, *_, n in far if n >= 6)


# 9 packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(7)
    rows = [(i, text(r, r.choice([5, 50, 300, 900])) if i % 7 else "It's <|endoftext|> a.b, É…«, don't!! " * r.randrange(5), "en", "s", 1) for i in range(150)]
    got = packing.pack_documents(odd_docs(spark, rows), path, capacity=1024).collect()
    tokens = Tokenizer.from_file(path)
    want = defaultdict(list)
    for i, t, *_ in [(x["doc_id"], x["text"]) for x in odd_docs(spark, rows).collect()]:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i].extend((p, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes())) for p, a in enumerate(range(0, len(ids), 1024)))
    own, bins = defaultdict(list), defaultdict(list)
    for x in got:
        own[x["id"]].append((x["piece"], x["start"], x["length"], x["crc"]))
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    plain: list = []
    packing.best_fit(plain, [], list(range(len(got))), [x["length"] for x in got], 1024)
    assert len(bins) <= len(plain) + 1
    assert packing.pack_documents(empty(spark), path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers_own(name):
    from tokenizers import Tokenizer

    r = random.Random(9)
    signs = ["a", "B", " ", " ", "\n", "\t", "\x1f", "\xa0", ".", ",", "'s", "'", "é", "e\u0301", "ß", "İ", "Σ", "语", "7", "#", "<|endoftext|>", "<|", "\u200b", "—", "ﬁ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", "<|endoftext|>", "plain words only"]
    words, whole = packing.TextIds(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert words.wordwise == name.startswith("word")
    for _ in range(2):  # the second time from what it remembers
        for some in (texts, [t.replace("<|", "") for t in texts]):
            for first, last, data, offsets in packing.text_chunks(pa.array(some), 5000):
                ids, where = words.encode(data, offsets)
                assert [ids[a:z].tolist() for a, z in zip(where[:-1], where[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in some[first:last]]


def test_the_search_beats_best_fit_on_lengths_that_are_hard_to_fit():
    r = random.Random(1)
    hard = [r.randrange(700, 2101) for _ in range(1500)]
    triples = [x for a, b in ((r.randrange(1000, 1600), r.randrange(1000, 1600)) for _ in range(500)) for x in (a, b, 4096 - a - b)]
    for size, gain in ((hard, 10), (triples, 30)):
        plain: list = []
        packing.best_fit(plain, [], list(range(len(size))), size, 4096)
        best = packing.evolve(size, 4096, 1, None)
        assert sorted(i for b in best for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 4096 for b in best)
        assert len(best) <= len(plain) - gain
        start = [packing.fullest(list(range(len(size))), size, 4096, random.Random(s)) for s in range(4)]
        assert len(best) <= min(map(len, start))


def test_children_hold_every_document_once():
    r = random.Random(8)
    size = [r.randrange(1, 60) for _ in range(80)]
    a, b = packing.evolve(size, 100, 1, None), []
    packing.best_fit(b, [], r.sample(range(80), 80), size, 100)
    for child in (packing.crossover(a, b, size, 100, r), packing.mutate(a, size, 100, r)):
        assert sorted(i for x in child for i in x) == list(range(80)) and all(sum(size[i] for i in x) <= 100 for x in child)


# 10 WARC


def test_warc_round_trip(spark):
    big, z, y = "<p>é" * 60, "z" * 200, "y" * 100
    rows = [(1, "u\r\nX: y", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", z), (8, "u", z), (7, "u", z), (2, None, big), (9, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", y), (None, "v", y)]
    got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))).collect()]
    refers = lambda i, t: 1 if t == big and i != 1 else 7 if t == z and i != 7 else None
    want = [(i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), "response" if refers(i, t) is None else "revisit", refers(i, t)) for i, _, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def members(data, n=1):
    import gzip

    cuts = [len(data) * i // n for i in range(n + 1)]
    return b"".join(gzip.compress(data[a:z]) for a, z in zip(cuts, cuts[1:]))


def test_streams_of_several_members_and_many_archives(spark, tmp_path):
    payloads = [(f"page {i} " * r).encode() for i, r in enumerate([0, 1, 50, 40_000, 3, 500_000, 7])]
    data = b"".join(warc.record(i, f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))
    for n, tail in ((1, b""), (3, b""), (4, b"\0" * 512)):
        (tmp_path / f"a{n}.warc.gz").write_bytes(members(data, n) + tail)
    done = warc.normalise(warc.archives_of(spark, str(tmp_path)), archive_bytes=100_000).cache()
    assert done.count() > 3
    (tmp_path / "no archive").mkdir()
    streamed = warc.normalise_files(spark, f"{tmp_path}/a*.warc.gz", archive_bytes=100_000)
    assert sorted((r["name"], bytes(r["archive"])) for r in streamed.collect()) == sorted((r["name"], bytes(r["archive"])) for r in done.collect())
    rows = warc.read_back(done).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in rows) == sorted([(i, len(p)) for i, p in enumerate(payloads)] * 3)
    by = {r["name"]: r["archive"] for r in done.collect()}
    entries = warc.sidecar(done).collect()
    assert len(entries) == 21
    for e in entries:  # a single record, sought by its offset
        (only,) = warc.records(zlib.decompress(by[e["name"]][e["at"] : e["at"] + e["length"]], 31))
        assert only[0]["warc-record-id"] == e["record_id"]
    for bad in (members(data)[:-20], members(data[:-30])):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.streamed(warc.inflated(pa.BufferReader(bad))))


def test_records_of_other_writers(spark, tmp_path):
    import gzip

    data = b"".join(b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length:%d\r\n\r\n%s\r\n\r\n" % (kind, i, len(block), block) for i, (kind, block) in enumerate([(b"warcinfo", b"software: x\r\n\r\n"), (b"request", b"GET /\r\n\r\n"), (b"response", b"")]))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    rows = warc.read_back(warc.normalise(warc.archives_of(spark, str(tmp_path)))).collect()
    assert [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in rows] == [(None, "warcinfo", 15), (None, "request", 9), (None, "response", 0)]
    assert rows[1]["payload_digest"] == hashlib.sha256(b"GET /\r\n\r\n").hexdigest()


def test_many_revisits_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    rows = [(i, "u", "x" * 150 + str(i % 4)) for i in range(40)]
    got = {x["page_id"]: (x["record_type"], x["refers_to"]) for x in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("response", None) if i < 4 else ("revisit", i % 4) for i in range(40)}


# pipeline


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, d)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        before, docs = docs, corpus_pipeline.written(kept, name)
        if name == "near_dup":
            sets = sets_of([(r["doc_id"], "".join(c.lower() if c.isascii() else c for c in r["text"])) for r in before.collect()], 5)
            want = brute_components(sets, 80, 100)
            assert {r["doc_id"] for r in docs.collect()} == {i for i in sets if want[i] == i}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()} <= set(texts)


def test_pipeline_on_planted_rows(spark, tmp_path):
    """run() over hand-made tables: who stays is known, and so are the ids of the pieces."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(17)
    kinds = {"aa": ["ka", "lo", "mu", "sa", "ri", "to", "ne"], "bb": ["stro", "grib", "plu", "nkt", "asch", "ver"]}
    prose = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows, labels, gone = [], [], set()
    for i in range(500):
        k = r.choice(["aa", "bb"])
        words = prose(k, r.choice([30, 60, 200])).split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilkor", "grundelo"]))
            gone.add(i)
        rows.append((i, " ".join(words), k))
        if i < 400:
            labels.append((i, int(i % 6 == 0)))
    items = [(j, prose("aa", 20)) for j in range(6)]
    rows += [(1000 + j, f"{prose('aa', 40)} {t} {prose('aa', 40)}", "aa") for j, t in items]  # leaks
    gone |= {1000 + j for j, _ in items}
    rows += [(2000 + j, rows[j * 6 + 1][1], rows[j * 6 + 1][2]) for j in range(20)]  # copies, and near ones
    rows += [(3000 + j, rows[j * 6 + 2][1] + " nearly", rows[j * 6 + 2][2]) for j in range(20) if len(rows[j * 6 + 2][1].split()) > 50]
    gone |= {i for i, *_ in rows if 2000 <= i < 4000}
    rows += [(4000, None, None), (4001, "", "aa"), (4002, "12 34 !", "bb"), (4003, "qwy xej zzuq vvyx wuxz " * 12, None), (4004, prose("bb", 9000), "bb")]
    gone |= {4000, 4001, 4002, 4003}
    spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], DOCS).withColumns({c: F.lit("x") for c in ("id", "score", "component", "pred", "piece")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == {i for i, *_ in rows} - gone
    tokens, texts = Tokenizer.from_file(corpus_pipeline.TOKENIZER), {i: t for i, t, _ in rows}
    bins = defaultdict(int)
    for x in got:
        own = np.array([*tokens.encode(texts[x["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        part = own[x["start"] : x["start"] + x["length"]]
        assert x["start"] == 4096 * x["piece"] and len(part) == x["length"] and zlib.crc32(part.tobytes()) == x["ids_crc32"]
        bins[x["sequence_id"]] += x["length"]
    assert max(bins.values()) <= 4096 and len(bins) == -(-sum(bins.values()) // 4096)


def test_pipeline_on_no_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# identity of words


def test_words_of_patterns_have_hashes_of_their_own():
    """A Thue-Morse word and its complement collide under every polynomial modulo a power of two; shingles and ids must tell them apart."""
    from cloudloom.llm import common

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    raw = f"{word} {other} {word.upper()} {word[:64]} {other[:64]}".encode()
    data = np.frombuffer(raw, np.uint8)
    starts, stops, _ = common.spans(data, np.array([0, len(raw)]))
    hashes = common.word_hashes(data, starts, stops).tolist()
    assert hashes[0] == hashes[2] and len(set(hashes)) == 4


def test_ids_of_words_with_equal_hashes(monkeypatch):
    """Even if all hashes were equal, a word never gets another word's ids."""
    monkeypatch.setattr(packing, "word_hashes", lambda data, starts, stops, lower=None: np.full(len(starts), 99, np.uint64))
    ids = packing.TextIds(public_tokenizers.path("word_bpe_49k.json"))
    for text_ in ("red green red blue", "blue red, red <|x|> green", "", "green green grey"):
        got, _ = ids.encode(np.frombuffer(text_.encode(), np.uint8), np.array([0, len(text_)]))
        assert got.tolist() == ids.tokenizer.encode(text_, add_special_tokens=False).ids
