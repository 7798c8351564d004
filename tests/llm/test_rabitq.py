"""One-bit codes: neighbours against brute force, bounds that hold, odd vectors."""

import numpy as np
import pytest

from millrace.llm.rabitq import estimates, nearest, rotation


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x, np.float32).astype(float) - np.array(v, np.float32).astype(float)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = d[:k]
    return out


def test_against_brute_force(spark):
    unit = np.random.default_rng(1)
    centres = unit.normal(size=(5, 24))
    rows = [(k, (centres[k % 5] + 0.5 * unit.normal(size=24)).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[0][1]) for k in range(40)]  # a very common vector
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [float("inf")] * 24), (2004, [None] + [1.0] * 23), (2005, [1.0] * 7), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = nearest(df.select("vec_id", "embedding"), df.where("vec_id % 20 = 0").select("vec_id", "embedding"), k=10, code_block=128, query_block=8).collect()
    want = brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(found) == set(want)
    right = sum(len({i for _, i in want[q]} & {i for _, i in found[q].values()}) for q in want)
    assert right >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert [found[q][k][0] for k in sorted(found[q])] == pytest.approx([d for d, _ in want[q]])
    assert [found[0][k][1] for k in range(1, 11)] == list(range(1000, 1010))


def test_bounds_hold():
    unit = np.random.default_rng(2)
    data, query, mean, turn = unit.normal(size=(5000, 64)), unit.normal(size=64), np.zeros(64), rotation(64)
    norm = np.sqrt((data**2).sum(1))
    x = data @ turn.T / norm[:, None]
    near, low = estimates(np.packbits(x > 0, axis=1), norm, np.abs(x).sum(1) / 8, query, turn, mean, 4.0)
    true = ((data - query) ** 2).sum(1)
    assert (low <= true + 1e-9).mean() > 0.999
    assert np.corrcoef(near, true)[0, 1] > 0.85


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], kind)
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert nearest(two.where("vec_id = 0"), two.where("vec_id = 0")).collect() == []


def test_vectors_of_doubles(spark):
    unit = np.random.default_rng(4)
    rows = [(k, [float(x) for x in unit.normal(size=16)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    all_ = np.array([v for _, v in rows])
    for r in nearest(df, df.where("vec_id % 50 = 0"), k=3).where("rank = 1").collect():
        d = np.sqrt(((all_ - all_[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        assert r.vec_id == int(d.argmin()) and abs(r.score - d.min()) < 1e-12
