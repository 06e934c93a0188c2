"""Whitening against numpy's eigenvalues and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from quillflow.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, whitened string"


def expected(rows):
    """Per row: (vec_id, n, deviation, whitened, explained), by numpy."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return []
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    grid = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in good if len(v) == size]
    fit = np.array(sorted({tuple(v) for _, v in grid}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(16, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    out = []
    for i, v in grid if count else []:
        away = np.array(v, object) * n - sums
        out.append((i, n, int((away ** 2).sum()), (away / n).astype(float) @ axes[:, :count] / np.sqrt(values[:count]),
                    values[:count] / np.trace(covariance)))
    return out


def agrees(spark, rows):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = whitening.whiten(frame).collect()
    want = expected(rows)
    assert len(got) == sum(len(w[3]) for w in want)
    left = {}
    for row in got:
        left.setdefault((row.vec_id, row.component), []).append(row)
    for i, n, deviation, white, explained in want:
        for k, (value, share) in enumerate(zip(white, explained), 1):
            rows_of = left[i, k]
            found = [r for r in rows_of if r.n == n and r.deviation == deviation and abs(abs(r.whitened) - abs(value)) < 1e-6]
            assert found, (i, k)
            assert found[0].explained == pytest.approx(share, rel=1e-6)
            assert found[0].identity_error < 1e-4
            rows_of.remove(found[0])


def test_whole_table(spark):
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    agrees(spark, [(r["vec_id"], r["embedding"]) for r in table])


def test_edges(spark):
    vectors = np.random.default_rng(0).standard_normal((40, 5)).tolist()
    odd = [(None, vectors[0]), (7, vectors[1]), (7, vectors[1]), (8, None), (9, []), (10, [1.0]), (12, [1.0, 2.0, None, 3.0, 4.0]),
           (13, [math.nan] * 5), (14, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    agrees(spark, [*enumerate(vectors), *odd])


def test_no_variance_and_no_rows(spark):
    agrees(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    agrees(spark, [])


def test_entries_beyond_the_grid(spark):
    rows = [(0, [1e30, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3}
    assert all(math.isfinite(r.whitened) for r in got)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from(["spread", "equal", "steep"]))
def test_leading_pairs(seed, size, kind):
    random = np.random.default_rng(seed)
    basis = np.linalg.qr(random.standard_normal((size, size)))[0]
    values = {"spread": random.uniform(0, 5, size), "equal": np.repeat([4.0, 1.0], [size // 2, size - size // 2]),
              "steep": 10.0 ** -np.minimum(np.arange(size), 10)}[kind]
    matrix = basis * values @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_pairs(matrix)
    want = np.sort(values)[::-1][:len(found)]
    assert len(found) == min(16, size)
    assert np.allclose(found, want, rtol=0, atol=1e-12 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.floats(-3, 3))
def test_inertia(seed, size, shift):
    matrix = np.random.default_rng(seed).standard_normal((size, size))
    matrix = matrix + matrix.T
    below = whitening.count_below(*whitening.tridiagonal(matrix), shift)
    assert below == int((np.linalg.eigvalsh(matrix) < shift).sum())
