"""Whitening against a dense eigendecomposition of exact moments."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """{(id, component): (n, deviation, whitened up to sign, explained)} with Python's integers for sums."""
    sound = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    y = np.array([[(n * x[j] - sums[j]) / n for j in range(dim)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in sound:
        own = [n * x[j] - sums[j] for j in range(dim)]
        z = (np.array(own) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(i, c + 1, n, sum(d * d for d in own), abs(z[c]), values[c] / values.sum()) for c in range(min(k, dim))]
    return sorted(out, key=str)


@pytest.mark.parametrize(("dim", "k"), [(64, 16), (5, 16), (40, 3)])
def test_against_a_dense_decomposition(spark, dim, k):
    random = np.random.default_rng(dim)
    data = random.standard_normal((300, dim)) * np.linspace(2, 0.3, dim)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("id", "x", "i", "z", "component")}).repartition(5)
    got = whitening.whiten(df, k).collect()
    want = brute(rows, k)
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in sorted(got, key=lambda r: str((r["vec_id"], r["component"], r["n"], int(r["deviation"]))))] == sorted((w[:4] for w in want), key=str)
    by = lambda r: (str(r[0]), r[1], r[3])
    a = sorted(((r["vec_id"], r["component"], 0, int(r["deviation"]), abs(r["whitened"]), r["explained"]) for r in got), key=by)
    b = sorted(want, key=by)
    assert np.allclose([r[4] for r in a], [r[4] for r in b], atol=1e-8) and np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-12)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    one = [(r["vec_id"], r["whitened"]) for r in got if r["component"] == 1]
    assert len({v for i, v in one if i is None or i == 3}) == 1  # a repeated vector is judged alike


@pytest.mark.parametrize("gap", [1.0, 1e-3, 1e-6])
def test_many_passes_of_few_columns(gap):
    """200 dimensions by blocks of 6: no pass spans the space, so residuals must fall by iterating; close eigenvalues too."""
    random = np.random.default_rng(3)
    basis = np.linalg.qr(random.standard_normal((200, 200)))[0]
    values = np.append([10 + gap, 10, 9, 5], np.linspace(4, 0.01, 196))
    v = basis * values @ basis.T
    found = whitening.lobpcg(lambda q: (v @ q, values.sum()), 200, 4, guard=2)
    assert found.passes > 5 and found.residuals.max() <= 1e-9 * values[0]
    assert np.allclose(found.values, values[:4], rtol=1e-12)
    same = np.abs(found.vectors[:, 2:].T @ basis[:, 2:4])
    assert np.allclose(same, np.eye(2), atol=1e-7)
    plane = found.vectors[:, :2].T @ basis[:, :2]  # the close pair: the plane at least
    assert np.allclose(plane @ plane.T, np.eye(2), atol=1e-8)


def test_uncertified_residuals_are_an_error():
    values = np.linspace(1, 0.999, 300)
    with pytest.raises(ValueError, match="residuals"):
        whitening.lobpcg(lambda q: (values[:, None] * q, values.sum()), 300, 2, guard=0, accept=1e-15, most=4)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [], 0), (4, [1e30, 0.0, 1.0], 0), (5, [-1e30, 1.0, 2.0], 0), (6, [0.5, 7.0, 1.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {4, 5, 6} and {r["n"] for r in got} == {3}  # lengths are fits of their own; one vector has no variance
    assert all(r["identity_error"] < 1e-4 for r in got) and all(int(r["deviation"]) > 10**24 for r in got if r["vec_id"] == 4)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [None], 0)], SCHEMA)).count() == 0
