import math

import numpy as np
import pytest

from kerbline.llm import whitening


def agree(r, most=64):
    values, z = whitening.leading(r, most)
    s = np.linalg.svd(r)[1]
    k = min(most, int((s > 1e-11 * max(s[0], 1e-300)).sum()))
    assert len(values) == k == z.shape[1]
    if k:
        assert np.abs(values / s[:k] ** 2 - 1).max() < 1e-9 * s[0] / s[k - 1]
        assert np.abs(z.T @ z - np.eye(k)).max() < 1e-11
        assert np.abs(r.T @ (r @ z) - z * values).max() < 1e-11 * s[0] ** 2
        assert all(c[np.argmax(np.abs(c))] > 0 for c in z.T)


def matrices():
    g = np.random.default_rng(3)
    turn = np.linalg.qr(g.normal(size=(40, 40)))[0]
    tri = lambda m: np.linalg.qr(m, mode="r")
    yield "random", tri(g.normal(size=(900, 40)))
    yield "spread over ten powers", tri(g.normal(size=(900, 40)) * np.logspace(0, -5, 40))
    yield "equal values", turn * 3.0
    yield "groups of equal values", tri(np.diag([5.0] * 8 + [4.0] * 8 + [1.0] * 24) @ turn)
    yield "nearly equal values", tri(np.diag([5 + i * 1e-9 for i in range(8)] + [4.0] * 8 + [1.0] * 24) @ turn)
    yield "rank five", tri(g.normal(size=(60, 5)) @ g.normal(size=(5, 40)))
    m = g.normal(size=(900, 40))
    m[:, [0, 7, 39]], m[:, 20] = 0, m[:, 5]
    yield "constant and repeated dimensions", tri(m)
    yield "diagonal", np.diag(np.arange(12.0))
    yield "one", np.array([[-2.0]])
    yield "none", np.zeros((4, 4))
    yield "pairs that hardly differ", np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)


@pytest.mark.parametrize("name, r", list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_leading_vectors(name, r):
    agree(r)


def test_small_whole_matrices():
    g = np.random.default_rng(5)
    for _ in range(300):
        n = int(g.integers(1, 14))
        agree(g.integers(-3, 4, size=(n, n)).astype(float) * (g.random((n, n)) < g.random()), 16)


def test_shift_that_is_too_large_is_lowered():
    up, _, at = whitening._transform([4.0, 3.0], [1.0], 3.9)
    assert at >= 0 and up[-1] < 0
    want = np.linalg.svd(np.array([[2.0, 1.0], [0.0, math.sqrt(3)]]))[1] ** 2
    assert np.allclose(whitening.dqds([4.0, 3.0], [1.0]), want, rtol=1e-14)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check(spark, rows, **options):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in usable), default=0)
    whole = [(i, tuple([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)))) for i, v in usable]
    fit = sorted({x for _, x in whole})
    got = whitening.whiten(table(spark, rows), **options).collect()
    n = len(fit)
    if n < 2:
        assert not got
        return
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    k = min(16, int((values > 1e-13 * values[-1]).sum()))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == k * len(whole)
    trace = (centred ** 2).sum() / n
    mine = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9
        mine.setdefault(r.component, []).append((str(r.vec_id), r.deviation, r.whitened))
    exact = {}
    for i, x in whole:
        exact.setdefault(str(i), []).append(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
    for c in range(1, k + 1):
        want = [(str(i), np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors[:, c - 1] / math.sqrt(values[c - 1])) for i, x in whole]
        assert sorted((i, d) for i, d, _ in mine[c]) == sorted((i, d) for i, ds in exact.items() for d in ds)
        a, b = sorted((i, w) for i, _, w in mine[c]), [sorted((i, s * w) for i, w in want) for s in (1, -1)]
        assert [i for i, _ in a] == [i for i, _ in b[0]]
        assert min(max(abs(x - y) for (_, x), (_, y) in zip(a, other)) for other in b) < 1e-7


def vectors(n, dim, seed=0):
    g = np.random.default_rng(seed)
    return [(i, [float(x) for x in g.normal(size=dim) * np.linspace(2.0, 0.4, dim)]) for i in range(n)]


@pytest.mark.parametrize("n, dim", [(400, 20), (60, 3), (9, 30)])
def test_equals_the_covariance_by_hand(spark, n, dim):
    check(spark, vectors(n, dim))


def test_copies_count_once_in_the_fit(spark):
    rows = vectors(50, 4)
    check(spark, rows + [(1000 + i, rows[7][1]) for i in range(500)] + rows[:10])


def test_odd_rows(spark):
    check(spark, vectors(20, 3) + [(0, None), (1, [1.0, None, 0.0]), (2, [float("nan")] * 3), (3, [float("-inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (4, []), (5, [2.0])])
    check(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    check(spark, [(1, [])])
    check(spark, [])
    check(spark, [(1, [0.5, 1.0]), (2, [0.5, -1.0])])


def test_large_entries_stay_exact(spark):
    rows = [(i, [2e6 * (i % 3), 1e4 * i, -1e6 * (i % 2)]) for i in range(8)]
    check(spark, rows)
    got = whitening.whiten(table(spark, [(i, [1e30 * (i % 2), float(i % 3)]) for i in range(6)])).collect()
    assert got and all(r.deviation is None for r in got)


def test_factors_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GROUP_DOUBLES", 10)
    check(spark, vectors(300, 5))


def test_equal_vectors_score_alike(spark):
    rows = vectors(80, 6)
    got = whitening.whiten(table(spark, rows + [(500 + i, rows[3][1]) for i in range(40)])).collect()
    assert len({r.whitened for r in got if r.component == 2 and (r.vec_id == 3 or r.vec_id >= 500)}) == 1
