import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import whitening as W


def determinant(m):
    m, out = [[Fraction(x) for x in row] for row in m], Fraction(1)
    for i in range(len(m)):
        j = next((j for j in range(i, len(m)) if m[j][i]), None)
        if j is None:
            return Fraction(0)
        if i != j:
            m[i], m[j], out = m[j], m[i], -out
        out *= m[i][i]
        for r in range(i + 1, len(m)):
            f = m[r][i] / m[i][i]
            m[r] = [a - f * b for a, b in zip(m[r], m[i])]
    return out


def scatter_of(rows):
    n, d = len(rows), len(rows[0])
    s = [sum(r[j] for r in rows) for j in range(d)]
    return [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in rows) // n for j in range(d)] for i in range(d)]


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    m = scatter_of([[int(x) + 1_000_000 for x in r] for r in rng.integers(-60, 60, (30, 7))])
    poly = W.characteristic(spark, m)
    assert poly[-1] == 1
    for x in (-3, 0, 10**6, 10**9 + 7):
        assert W.value(poly, x) == determinant([[(x if i == j else 0) - m[i][j] for j in range(7)] for i in range(7)])


def test_roots_single_multiple_and_tiny():
    def product(roots):
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
        return poly

    poly = product([9, 9, 9, 5, 1 << 70, (1 << 70) + 1])
    found = [W.isolated(poly, k, 1 << 72) for k in range(1, 7)]
    assert [Fraction(r, 1 << b) for r, b, _, _ in found[:2]] == [(1 << 70) + 1, 1 << 70]
    assert [(f, c) for _, _, f, c in found] == [(1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (6, 1)]
    assert all(abs(Fraction(r, 1 << b) - 9) < Fraction(1, 1 << 100) for r, b, _, _ in found[2:5])


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, v array<long>, doc string, n int").repartition(3)


def checked(spark, vectors, most=16):
    """Runs the operator and holds it against exact integers and double-precision eigenvalues."""
    got = W.whitened(frame(spark, vectors), most).collect()
    rows = sorted({tuple(v) for _, v in vectors if v is not None})
    n, d = len(rows), len(rows[0])
    s = [sum(r[j] for r in rows) for j in range(d)]
    want = sorted((i is None, i or 0, str(sum((n * x - t) ** 2 for x, t in zip(v, s)))) for i, v in vectors if v is not None)
    assert sorted((r["doc"]["vec_id"] is None, r["doc"]["vec_id"] or 0, r["deviation"]) for r in got) == want
    assert all(r["n"] == n for r in got)
    centred = np.array([[float(n * x - t) for x, t in zip(r, s)] for r in rows]) / n
    e = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    by_vector = {tuple(r["doc"]["v"]): r["whitened"] for r in got}
    w = np.array([by_vector[r] for r in rows], dtype=np.float64)
    return got, e, centred, w


def test_whitened(spark):
    rng = np.random.default_rng(2)
    mixed = np.floor(rng.normal(0, 1, (200, 20)) @ np.diag(np.arange(1, 21)) * 64).astype(int) + 1_000_000
    vectors = [(i, [int(x) for x in r]) for i, r in enumerate(mixed)]
    vectors += [(300, vectors[0][1])] * 90 + [(301, None), (None, vectors[1][1])]
    got, e, centred, w = checked(spark, vectors)
    assert np.allclose(w.T @ w / len(w), np.eye(16), atol=1e-12) and np.allclose(w.mean(axis=0), 0, atol=1e-12)
    assert np.allclose(got[0]["explained"], e[:16] / e.sum(), rtol=1e-10)
    assert 0 <= got[0]["identity_error"] < 1e-10
    # Projections are those of the eigenvectors: the covariance of vectors with whitened values is e * u / sqrt(e).
    u = centred.T @ w / len(w) / np.sqrt(e[:16])
    assert np.allclose(u.T @ u, np.eye(16), atol=1e-9)
    assert np.allclose(centred.T @ (centred @ u) / len(w), u * e[:16], rtol=0, atol=e[0] * 1e-10)


def test_equal_roots_and_roots_of_zero(spark):
    # A cross: three equal roots, a fourth entry that never varies.
    cross = [[5 if j == i else 0 for j in range(3)] + [9] for i in range(3)] + [[-5 if j == i else 0 for j in range(3)] + [9] for i in range(3)]
    got, e, _, w = checked(spark, list(enumerate(cross)))
    assert np.allclose((w[:, :3].T @ w[:, :3]) / 6, np.eye(3), atol=1e-12)
    assert all(r["whitened"][3] is None and r["explained"][3] == 0.0 for r in got)
    got = W.whitened(frame(spark, [(1, [3, 4]), (2, [3, 4])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, "0", [None, None], [None, None], None)] * 2


def test_odd_rows(spark):
    assert W.whitened(frame(spark, [])).count() == 0
    assert W.whitened(frame(spark, [(1, None), (2, None)])).count() == 0
    assert W.whitened(frame(spark, [(1, []), (2, [])])).count() == 0
    got = W.whitened(frame(spark, [(1, [1, 2]), (2, [2, 5]), (3, [1, 2, 3])])).collect()
    assert sorted(r["doc"]["vec_id"] for r in got) == [1, 2]
    huge = [(1, [2**50, 0]), (2, [-(2**50), 7]), (3, [2**50, 9])]
    got, _, _, w = checked(spark, huge)
    assert np.allclose(w.T @ w / 3, np.eye(2), atol=1e-9)


@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None])
def test_shifted(spark, bad):
    rows = spark.createDataFrame([(bad,), ([0.5, -0.001],), ([3e38, -3e38],)], "embedding array<float>")
    got = [r[0] for r in rows.select(W.shifted(F.col("embedding"))).collect()]
    assert got == [None, [1_000_032, 999_999], [2**50 + 1_000_000, -(2**50) + 1_000_000]]
    assert math.floor(-0.001 * 64) == -1
