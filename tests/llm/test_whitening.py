"""Whitening against a dense eigensolver; LOBPCG alone on hard spectra; odd vectors."""

from decimal import Decimal

import numpy as np
import pytest

from millrace.llm.whitening import Centre, lobpcg, whiten

KIND = "vec_id long, embedding array<float>"


def dense(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, d = len(x), x - x.mean(0)
    values, turn = np.linalg.eigh(d.T @ d / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return n, ((n * x - x.sum(0)) ** 2).sum(1), d @ turn / np.sqrt(values), values / np.trace(d.T @ d / n)


def test_against_a_dense_solver(spark):
    unit = np.random.default_rng(1)
    vectors = (unit.normal(size=(400, 20)) * np.linspace(3, 0.2, 20) + 0.3).tolist()
    vectors += [vectors[0]] * 150  # a third of the rows are one vector
    rows = list(enumerate(vectors))
    odd = [(900, None), (901, [float("nan")] * 20), (902, [None] + [1.0] * 19), (903, [float("inf")] + [1.0] * 19), (904, [1.0] * 7), (905, [])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows + odd], "vec_id long, embedding array<float>, n long")
    got = whiten(df.repartition(5)).collect()
    n, deviation, white, explained = dense(vectors, 8)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    for c in range(1, 9):
        own = np.array([by[c][i].whitened for i in range(n)])
        assert min(np.abs(own - white[:, c - 1]).max(), np.abs(own + white[:, c - 1]).max()) < 1e-9
        assert by[c][0].explained == pytest.approx(explained[c - 1], rel=1e-10)
        assert [by[c][i].deviation for i in range(n)] == [Decimal(int(d)) for d in deviation]
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_null_ids_repeats_and_little(spark):
    two = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 0.0])], KIND)
    got = whiten(two).collect()
    assert [(r.component, r.n) for r in got] == [(1, 3)] * 3  # the second dimension has no variance
    assert sorted(round(abs(r.whitened), 9) for r in got) == [0.707106781, 0.707106781, 1.414213562]
    assert whiten(spark.createDataFrame([], KIND)).collect() == []
    assert whiten(two.where("vec_id = 3")).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], KIND)).collect() == []
    assert whiten(spark.createDataFrame([(k, [5.0, 1.0]) for k in range(4)], KIND)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2.0**30 * k), float(-k), 0.5 * k]) for k in range(40)]
    got = {r.vec_id: r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()}
    x = [[int(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert all(got[k].deviation == sum((40 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in enumerate(x))


def test_integers_and_python_integers_agree():
    x = np.random.default_rng(3).integers(-1000, 1000, (50, 6))
    small = Centre(50, [int(s) for s in x.sum(0)], 2000)
    large = Centre(50, small.sums, 1 << 60)
    assert (small.deviations(x) == large.deviations(x)).all() and small.squared(x).to_pylist() == large.squared(x).to_pylist()


@pytest.mark.parametrize("values", [np.linspace(1, 0.98, 60), np.r_[np.ones(5), np.linspace(0.5, 0, 55)], 0.5 ** np.arange(60.0), np.r_[[1e6, 1.0], np.full(58, 1e-3)], np.r_[np.ones(3), np.zeros(57)]])
def test_hard_spectra(values):
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(60, 60)))[0]
    matrix = (turn * values) @ turn.T
    vectors, found, residual, _ = lobpcg(lambda b: matrix @ b, 60, 8)
    assert residual < 1e-11
    assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * values.max()


def test_no_convergence_is_an_error():
    matrix = np.diag(np.linspace(1, 0.99, 200))
    with pytest.raises(ArithmeticError):
        lobpcg(lambda b: matrix @ b, 200, 8, rounds=3)
