import math
from fractions import Fraction

import numpy as np
import pytest

from strandline.llm.whitening import back, leading_components, op13_embedding_whitening, sturm_counts, tridiagonal, whiten


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    a = q * np.array(values) @ q.T
    return (a + a.T) / 2


def test_tridiagonal_form():
    a = symmetric([5, 3, 2, 1, 0.5, -1, 7])
    d, e, reflections = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    q = back(np.eye(7), reflections)
    assert np.allclose(q @ t @ q.T, a, atol=1e-13) and np.allclose(q.T @ q, np.eye(7), atol=1e-14)
    at = np.array([-2, -0.5, 0.7, 4.0, 8.0])
    assert sturm_counts(d, e, at).tolist() == [(np.linalg.eigvalsh(a) < v).sum() for v in at]


@pytest.mark.parametrize(
    "values",
    [range(1, 40), [9, 9, 9, 9, 9, 1, 1], [5, 5 - 1e-12, 5 - 2e-12, 1, 0], [1e-9, 1e-10, 1e-11, 1e-12, 0], [3.0], [2, 1], [1e12, 1e3, 1, 0.5], [4, 0, 0, 0, 0], [1] * 6],
)
def test_components(values):
    a = symmetric(list(values)) if len(list(values)) > 1 else np.array([[3.0]])
    got, vectors = leading_components(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    norm = max(abs(want))
    want = want[: len(got)]
    assert len(got) == min(4, sum(v > len(a) * np.finfo(float).eps * norm for v in values))
    assert np.allclose(got, want, atol=1e-14 * norm * len(a), rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-13)
    assert np.abs(a @ vectors - vectors * got).max() <= 2e-14 * norm * len(a)


def test_diagonal_and_zero_matrices():
    got, vectors = leading_components(np.diag([1.0, 7.0, 3.0]), 2)
    assert np.allclose(got, [7, 3], rtol=1e-15) and np.abs(vectors).argmax(axis=0).tolist() == [1, 2]
    assert len(leading_components(np.zeros((3, 3)), 4)[0]) == 0


def brute(rows, count=4):
    """By exact fractions and numpy's own solver."""
    xs = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n, dim = len(fit), len(fit[0])
    s = [sum(col) for col in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    keep = e > dim * np.finfo(float).eps * max(e.max(), 1e-300)
    e, u = e[keep], u[:, keep]
    out = {}
    for i, x in xs:
        w = (np.array(x) - np.array([t / n for t in s])) @ u / np.sqrt(e)
        out.setdefault(i, []).append((n, sum((n * c - t) ** 2 for c, t in zip(x, s)), w, e / np.trace(v)))
    return out


def compare(got, rows):
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(want)
    sign = {}
    for i, found in by.items():
        ways = want[i]
        assert len(found) == sum(len(w[3]) for w in ways)
        for r in found:
            n, deviation, w, explained = ways[0]
            k = r.component - 1
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - abs(w[k])) < 1e-8
            if abs(w[k]) > 1e-3:
                assert sign.setdefault(k, np.sign(w[k] * r.whitened)) == np.sign(w[k] * r.whitened)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op13_embedding_whitening(spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), rows)


def test_odd_tables(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(c) for c in random.standard_normal(3) * [1, 2, 300]]) for i in range(40)]
    rows += [(100, rows[0][1])] * 15 + [(None, [0.0, -0.0, 1e-9])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows + bad], "vec_id long, embedding array<double>, n double")
    compare(whiten(df).collect(), rows)
    # nothing varies: no component
    assert whiten(df.where("vec_id = 100")).count() == 0 and whiten(df.where("vec_id >= 200 and vec_id < 205")).count() == 0 and whiten(df.limit(0)).count() == 0
    line = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in whiten(line).collect())
    assert got == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)]


def test_wide_numbers_are_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5.0, 2e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(whiten(df).collect(), rows)
