"""Whitening: its polynomial, roots and components against exact and numpy versions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import whitening as W

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<double>, label int, component int, n string, u int"


def plain_polynomial(a):
    """Faddeev and LeVerrier, in whole numbers."""
    d = len(a)
    a, m, c = np.array(a, object), np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + c[-1] * np.eye(d, dtype=int).astype(object)
        t = a.dot(m).trace()
        assert t % k == 0
        c.append(-t // k)
    return c[::-1]


def scatter_like(d, seed, rank=None, top=1000):
    g = np.random.default_rng(seed).integers(-top, top, (rank or d, d)).astype(object)
    return g.T.dot(g).tolist()


@pytest.mark.parametrize("a", [[[5]], [[0, 0], [0, 3]], np.diag([4, 4, 4, 9, 0]).tolist(), scatter_like(7, 1), scatter_like(9, 2, rank=4), scatter_like(12, 3, top=10**9)])
def test_polynomial_is_exact(spark, a):
    assert W.characteristic_polynomial(spark, a) == plain_polynomial(a)


def test_primes():
    p = W._primes(500)
    assert p[:3] == [2147483647, 2147483629, 2147483587] and len(set(p)) == len(p) and math.prod(p[:-1]).bit_length() > 501
    assert all(x % q for x in p[:3] for q in range(2, 46341))


def test_roots_and_components_of_repeated_values(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 10, 6).astype(object)
    # 1000 on all but one direction: a fivefold root and a larger one
    a = (1000 * np.eye(6, dtype=int).astype(object) + np.outer(v, v)).tolist()
    poly = W.characteristic_polynomial(spark, a)
    roots = W.largest_roots(poly, sum(a[i][i] for i in range(6)), 6)
    assert [r.times for r in roots] == [1, 5]
    assert roots[0].value == pytest.approx(1000 + int(v @ v), rel=1e-25) and abs(roots[1].value - 1000) < Fraction(1, 2**80)
    y = np.array([x for r in roots for x in W.null_vectors(a, r)])
    np.testing.assert_allclose(y @ y.T, np.eye(6), atol=1e-15)
    np.testing.assert_allclose(np.array(a, float) @ y.T, y.T * [float(r.value) for r in roots for _ in range(r.times)], atol=1e-11)
    assert W.largest_roots(plain_polynomial([[0, 0], [0, 3]]), 3, 2)[0].times == 1


def test_close_values_are_told_apart(spark):
    a = np.diag([10**30, 10**30 + 1, 7, 5]).tolist()  # a gap of one in 10^30
    roots = W.largest_roots(W.characteristic_polynomial(spark, a), 3 * 10**30, 4)
    assert [round(r.value) for r in roots] == [10**30 + 1, 10**30, 7, 5]
    assert [int(np.argmax(W.null_vectors(a, r)[0])) for r in roots] == [1, 0, 2, 3]


def check(rows, vectors, components=16):
    ok = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in ok])
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(axis=0)
    cov = (f - f.mean(axis=0)).T @ (f - f.mean(axis=0)) / n
    e = np.linalg.eigvalsh(cov)[::-1]
    e = e[e > 1e-9 * e[0]][:components]
    assert len(rows) == len(ok) * len(e) and {r.n for r in rows} == {n}
    dev = sorted((i or 0, int(((n * v - s) ** 2).sum())) for (i, _), v in zip(ok, x, strict=True))
    for k, value in enumerate(e, 1):
        mine = [r for r in rows if r.component == k]
        assert sorted((r.vec_id or 0, r.deviation) for r in mine) == dev
        assert all(r.explained == pytest.approx(value / np.trace(cov), rel=1e-9) for r in mine) and mine[0].identity_error < 1e-8
    # whitened values as inner products do not hang on the choice of signs and bases
    z = {}
    for r in rows:
        z.setdefault(r.vec_id, {})[r.component] = r.whitened
    c = (x - s / n) @ np.linalg.eigh(cov)[1][:, ::-1][:, : len(e)] / np.sqrt(e)
    ids = [i for i, _ in ok]
    if len(set(ids)) == len(ids):
        got = np.array([[z[i][k] for k in range(1, len(e) + 1)] for i in ids])
        np.testing.assert_allclose(got @ got.T, c @ c.T, atol=1e-6)


def test_digest_on_the_small_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(W.digest(v).collect(), [(r.vec_id, r.embedding) for r in v.collect()])


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [NAN, 1.0, 1.0, 1.0, 1.0]), (103, [INF] * 5), (104, [None, 1.0]), (105, [1.0, -0.0]), (106, [2.0, 0.0, 0.0, 0.0, 0.0]), (107, rows[0][1]), (None, rows[1][1])]
    table = spark.createDataFrame([(i, v, 1, 2, "n", 3) for i, v in rows], KIND)
    check(W.digest(table).collect(), rows)
    # equal ids and equal rows come as often as they are
    twice = W.digest(table.union(table)).collect()
    once = W.digest(table).collect()
    key = lambda r: (r.vec_id or 0, r.component, round(r.whitened, 9), r.n, r.deviation)
    assert sorted(map(key, twice)) == sorted([key(r) for r in once] * 2)


def test_nothing_to_whiten(spark):
    table = lambda rows: spark.createDataFrame([(i, v, 1, 2, "n", 3) for i, v in rows], KIND)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        got = W.digest(table(rows))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # one direction only, and entries far beyond the scale
    flat = W.digest(table([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])])).collect()
    assert {(r.component, r.explained) for r in flat} == {(1, 1.0)} and sorted(r.deviation for r in flat) == [64**2, 256**2, 320**2]
    far = W.digest(table([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])).collect()
    assert len(far) == 6 and max(r.deviation for r in far) == 2**63 - 1 and far[0].identity_error < 1e-8
