"""Cross-tokenizer alignment against a brute-force version."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from cloudloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(docs):
    """Rows as dicts, from all pairs of tokens of each text, with the file's own tokenizer."""
    from tokenizers import Tokenizer

    own, left, right = Tokenizer.from_file(A), alignment.ByteLevel(A), alignment.Pieces(B)
    own.encode_special_tokens = True
    rows, links = [], []
    for doc, text in docs:
        row = {"id": doc, "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": ""}
        rows.append(row)
        links.append([])
        if not text:
            continue
        a, b = own.encode(" " + text, add_special_tokens=False).ids, right.model.encode(text)
        if b"".join(left.bytes[i] for i in a) != (" " + text).encode() or b"".join(right.bytes[i] for i in b) != (" " + text).encode():
            continue
        ends = [[sum(len(t.bytes[i]) for i in ids[: k + 1]) for k in range(len(ids))] for t, ids in ((left, a), (right, b))]
        links[-1] = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ends[0][i] == ends[1][j]]
        cuts, groups, before = sorted(set(ends[0]) & set(ends[1])), [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, own_ends) if before < e <= c) for ids, own_ends in zip((a, b), ends)))
            before = c
        row |= {"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest()}
    counts = Counter(x for own_links in links for x in own_links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    for row, own_links in zip(rows, links):
        row |= {"n_links": len(own_links), "n_best": sum(counts[x] == most[x[1]] for x in own_links), "count_sum": sum(counts[x] for x in own_links)}
    return rows


TEXTS = ["Hello world", "", None, " ", "  two  blanks\n\n\tand tabs ", "naïve façade — 東京 🙂🙂 zażółć", "<|endoftext|> and <s> </s> are text", "▁ is no blank", "é é ﬁ ①", "x" * 700, "Hello world", "a,b,,c 12345 don't I'll", "\x00\x07 ﻿‍", "the the the the"]


@pytest.mark.parametrize(("in_memory", "chunk"), [(2_000_000, 500_000), (3, 40)])
def test_against_all_pairs_of_tokens(spark, monkeypatch, in_memory, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "COUNTED", chunk)
    docs = [*enumerate(TEXTS), (None, "Hello world"), (3, "again, world"), *((100 + i, f"the {i % 7} of, words {i}") for i in range(40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "row", "a", "b", "pair", "n", "times")}).repartition(3)
    got = alignment.link_counts(alignment.align(df, A, B), in_memory).drop("row").collect()
    key = lambda r: (str(r["id"]), r["groups_sha256"])
    assert sorted((r.asDict() | {"count_sum": int(r["count_sum"])} for r in got), key=key) == sorted(brute(docs), key=key)


def test_no_rows(spark):
    assert alignment.link_counts(alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)).count() == 0


def test_overlaps_and_groups():
    import numpy as np

    a_ends, b_ends = np.array([2, 4, 6, 7]), np.array([1, 3, 4, 7])
    first, last = alignment.overlaps(a_ends, b_ends)
    assert [*zip(first.tolist(), last.tolist())] == [(0, 2), (1, 3), (3, 4), (3, 4)]
    group_a, group_b, link_a, link_b = alignment.aligned(np.arange(4), np.arange(4), a_ends, b_ends)
    assert group_a.tolist() == [0, 0, 1, 1] and group_b.tolist() == [0, 0, 0, 1]
    assert link_a.tolist() == [1, 3] and link_b.tolist() == [2, 3]


def test_ranked_encoder_is_the_files_own():
    """Every token's bytes encode to it (so both ways of merging agree), and texts of every character encode alike."""
    left = alignment.ByteLevel(A)
    assert left.ranked is not None
    vocab = json.loads(left.tokenizer.to_str())["model"]["vocab"]
    assert all([t.id for t in left.tokenizer.model.tokenize(name)] == [i] for name, i in vocab.items() if name != "<|endoftext|>")
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xF900 and c < 0x32000]
    texts = ["".join(f"a{c}a {c}1{c} {c}{c}" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    assert left.encode(texts) == [x.ids for x in left.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
