"""Whitening against exact sums and eigenvectors in extended precision."""

import math
from fractions import Fraction

import numpy as np
import pytest

from groundmesh.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, n long, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], ROWS)


def exactly(rows):
    """Usable rows, whole vectors, mean as fractions, covariance in extended precision."""
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in usable], dtype=object)
    n = len(x)
    sums = [sum(c) for c in x.T]
    centred = [[Fraction(n * c - s, n) for c, s in zip(row, sums, strict=True)] for row in x.tolist()]
    d = len(sums)
    v = np.array([[np.longdouble(p.numerator) / np.longdouble(p.denominator) for p in (sum(r[i] * r[j] for r in centred) / n for j in range(d))] for i in range(d)])
    return usable, x, n, sums, centred, v


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12)) * 0.1
    found = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(mixed)]
    return found + [(60, found[1][1]), (None, found[2][1]), (61, None), (62, []), (63, [math.nan] * 12), (64, [math.inf] + [0.0] * 11), (65, [None] + [0.0] * 11)]


def test_whitened_vectors_against_exact_arithmetic(spark, rows):
    got = whitening.whiten(table(spark, rows)).collect()
    usable, x, n, sums, centred, v = exactly(rows)
    assert len(got) == 8 * len(usable) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    values, vectors = np.linalg.eigh(v.astype(np.float64))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(8):
        e, u = values[::-1][k], vectors[:, ::-1][:, k]
        want = np.array([float(sum(Fraction(float(c)) * y for c, y in zip(u, row, strict=True))) for row in centred]) / math.sqrt(e)
        have = np.array([by[(i, k + 1)][0].whitened for i, _ in usable])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert all(abs(by[(i, k + 1)][0].explained - e / np.trace(v)) < 1e-12 for i, _ in usable)
    for (i, _), row in zip(usable, x.tolist(), strict=True):
        assert {r.deviation for r in by[(i, 1)]} == {sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_clustered_eigenvalues_get_orthonormal_vectors():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0].astype(np.longdouble)
    q = q - q @ (q.T @ q - np.eye(20, dtype=np.longdouble)) / 2  # orthonormal beyond double precision
    q = q - q @ (q.T @ q - np.eye(20, dtype=np.longdouble)) / 2
    for values in ([*(1 + np.arange(10) * 1e-9), *np.arange(2, 12)], [1.0] * 20, [1.0, 1.0, *np.geomspace(1e-6, 1e3, 18)], [*(7 + np.arange(3) * 1e-12), *range(17)]):
        values = np.sort(np.array(values, dtype=np.longdouble))[::-1]
        v = q @ np.diag(values) @ q.T
        v = (v + v.T) / 2
        found, x = whitening.eigenvectors(v)
        scale = float(values[0])
        assert np.abs(x.T @ x - np.eye(20)).max() < 1e-15 and np.abs(found - values).max() < 1e-15 * scale
        assert np.abs(v @ x - x * found).max() < 1e-15 * scale
        apart = [k for k in range(20) if min((abs(values[k] - values[j]) for j in range(20) if j != k)) > 1e-10 * scale]
        for k in apart:  # each vector by itself, to double precision
            assert min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max()) < 1e-8


def test_float32_alone_would_not_do():
    rng = np.random.default_rng(6)
    m = rng.normal(size=(500, 30)) @ rng.normal(size=(30, 30))
    v = (m.T @ m / 500).astype(np.longdouble)
    crude = np.linalg.eigh(v.astype(np.float32))[1].astype(np.longdouble)
    found, x = whitening.eigenvectors(v)
    residual = lambda y: np.abs(v @ y - y * np.diag(y.T @ v @ y)).max() / np.abs(v).max()
    assert residual(crude) > 1e-9 and residual(x) < 1e-17


def test_flat_dimensions_few_dimensions_and_few_rows(spark):
    flat = [(i, [float(i), 1.0, float(i)]) for i in range(5)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-12 and abs(got[0].explained - 1) < 1e-12
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25])])).collect() == []  # one row has no variance
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []
    mixed = [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0])]
    assert {r.vec_id for r in whitening.whiten(table(spark, mixed)).collect()} == {1, 2}


def test_beyond_whole_numbers_is_an_error(spark):
    with pytest.raises(Exception, match="a scaled entry is beyond"):
        whitening.whiten(table(spark, [(1, [1e30, 1.0]), (2, [0.0, 1.0])])).collect()
    with pytest.raises(Exception, match="a deviation is beyond"):
        whitening.whiten(table(spark, [(1, [1e10, 1.0]), (2, [0.0, 2.0])])).collect()
