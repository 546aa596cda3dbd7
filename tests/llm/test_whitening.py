"""Whitening against exact fractions and a plain eigenvalue routine."""

import math
from fractions import Fraction

import numpy as np
import pytest

from treeline.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, component int, x string"


def whitened(spark, vectors, **more):
    rows = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], SCHEMA)
    return sorted(whitening.whiten(rows, **more).collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component))


def plain(vectors):
    """Integer vectors, exact deviations, eigenvalues and components of the covariance."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], axes[:, ::-1].T


def test_same_as_a_plain_eigenvalue_routine(spark):
    rows = queries.op11_whitening(spark, FOLDER).collect()
    given = sorted(spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    deviation, centred, values, axes = plain([r.embedding for r in given])
    assert len(rows) == 8 * len(given)
    assert {(r.n, round(r.identity_error, 9)) for r in rows} == {(len(given), 0.0)}
    shares = dict((r.component, r.explained) for r in rows)
    assert np.allclose([shares[k] for k in range(1, 9)], values[:8] / values.sum(), rtol=1e-12)
    by_place = {r.vec_id: i for i, r in enumerate(given)}
    assert all(r.deviation == deviation[by_place[r.vec_id]] for r in rows)
    got = np.zeros((len(given), 8))
    for r in rows:
        got[by_place[r.vec_id], r.component - 1] = r.whitened
    expected = centred @ axes[:8].T / np.sqrt(values[:8])
    assert np.allclose(got * np.sign(got[0]), expected * np.sign(expected[0]), atol=1e-8)


def test_large_entries_need_several_limbs(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 5)) * 10.0 ** rng.integers(0, 9, 5)).tolist()
    deviation, centred, values, _ = plain(vectors)
    rows = whitened(spark, vectors)
    assert [r.deviation for r in rows if r.component == 1] == deviation
    shares = {r.component: r.explained for r in rows}
    assert math.isclose(shares[1], values[0] / values.sum(), rel_tol=1e-12) and len(shares) == 5
    assert rows[0].identity_error < 1e-6


def test_equal_eigenvalues_give_an_orthonormal_basis(spark):
    corners = [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    rows = whitened(spark, corners)
    assert len(rows) == 24 and rows[0].identity_error < 1e-12
    assert all(math.isclose(r.explained, 1 / 3) for r in rows)


@pytest.mark.parametrize("far", [1e-3, 1.0])
def test_close_eigenvalues_stay_apart(spark, far):
    vectors = [[100.0, 0.0], [-100.0, 0.0], [0.0, 100.0 + far], [0.0, -100.0 - far]]
    rows = [r for r in whitened(spark, vectors) if r.component == 1]
    assert [abs(round(r.whitened, 3)) for r in rows] == [0, 0, 1.414, 1.414]


def test_dropped_rows_and_missing_components(spark):
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1e30, 0.0], [1.0, 2.0, 3.0]]
    line = [[1.0, 2.0], [2.0, 4.0], [2.0, 4.0], [3.0, 6.0]]
    rows = whitened(spark, bad + line)
    assert [(r.vec_id, r.component) for r in rows] == [(i + len(bad), 1) for i in range(4)]
    assert {r.n for r in rows} == {4} and {r.explained for r in rows} == {1.0}
    assert rows[1].whitened == rows[2].whitened
    assert whitened(spark, [[1.0, 2.0]] * 3) == [] and whitened(spark, bad[:6]) == [] and whitened(spark, []) == []


def test_polynomial_and_root_counts():
    rng = np.random.default_rng(2)
    factor = rng.integers(-9, 10, (6, 4))
    matrix = (factor @ factor.T).astype(object)
    p = whitening.primes_below(1 << 31, 3)
    assert p == [2147483647, 2147483629, 2147483587]
    exact = np.round(np.poly(matrix.astype(float)))[::-1].astype(object)
    rest = whitening.polynomial_mod(matrix, p[0])
    assert [int(c) % p[0] for c in exact] == rest
    roots = whitening.Roots([int(c) for c in exact])
    assert roots.zeros == 2 and roots.positive == 4
    values = np.linalg.eigvalsh(matrix.astype(float))[::-1]
    found = [r / 2**whitening.FRACTION for r in roots.largest(8)]
    assert np.allclose(found, values[:4])
