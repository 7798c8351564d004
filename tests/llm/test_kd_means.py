"""Centroid clustering against plain rounds; trees against all distances; the query against its SQL; odd vectors."""

import hashlib

import duckdb
import numpy as np
import pytest

from millrace.llm import registry
from millrace.llm.kd_means import Tree, cluster

KIND = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3):
    vectors = [np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "", vectors[i].tolist()))
    centroids = [vectors[i] for i in order[:k]]
    near = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        to = [near(v)[1] for v in vectors]
        centroids = [np.sum([v for v, t in zip(vectors, to, strict=True) if t == j], 0) // to.count(j) if j in to else c for j, c in enumerate(centroids)]
    out = [(i, *reversed(near(v))) for (i, _), v in zip(rows, vectors, strict=True)]
    inertia = [sum(d for _, c, d in out if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), tuple(centroids[c].tolist())) for i, c, d in out), key=repr)


def plain(df):
    return sorted(((r.vec_id, r.cluster, r.distance, int(r.cluster_inertia), int(r.inertia), tuple(r.centroid)) for r in df.collect()), key=repr)


def test_against_plain_rounds(spark):
    unit = np.random.default_rng(1)
    middles = unit.normal(size=(9, 64)) * 2
    rows = [(k, (middles[k % 9] + 0.3 * unit.normal(size=64)).round(2).tolist()) for k in range(500)]
    rows += [(1000 + k, rows[7][1]) for k in range(250)] + [(5, rows[5][1]), (None, rows[9][1]), (None, rows[9][1])]
    odd = [(2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [float("nan")] + [1.0] * 63), (2004, [float("-inf")] + [1.0] * 63), (2005, [1e30] * 64), (2006, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], KIND + ", cluster int").repartition(3)
    for block, leaf in ((4096, 16), (50, 4), (7, 1)):
        assert plain(cluster(df, block=block, leaf=leaf)) == brute(rows)


def test_ties_and_empty_centroids(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(40)]  # two points, sixteen centroids on them
    got = plain(cluster(spark.createDataFrame(rows, KIND), leaf=1))
    assert got == brute(rows)
    assert len({c for _, c, *_ in got}) == 2


def test_few_and_none(spark):
    assert cluster(spark.createDataFrame([], KIND)).collect() == []
    assert cluster(spark.createDataFrame([(1, None)], KIND)).collect() == []
    rows = [(1, [0.5] * 64), (2, [-0.51] * 64)]
    assert plain(cluster(spark.createDataFrame(rows, KIND))) == brute(rows)


@pytest.mark.parametrize("scale", [3, 40, 1 << 26])
def test_trees_against_all_distances(scale):
    unit = np.random.default_rng(scale)
    points, centroids = unit.integers(-scale, scale, (700, 5)), unit.integers(-scale, scale, (12, 5))
    points[100:400] = points[0]
    distances = ((points[:, None] - centroids) ** 2).sum(2)
    tree = Tree.grown(points, 4)
    to, own = tree.assigned(centroids)
    assert (to == distances.argmin(1)).all() and (own == distances.min(1)).all()
    counts, sums = tree.totals(centroids)
    assert counts.tolist() == np.bincount(to, minlength=12).tolist()
    assert (sums == np.array([points[to == c].sum(0) for c in range(12)])).all()
    assert (tree.low <= tree.high).all() and (tree.points[np.argsort(tree.order)] == points).all()


def test_whole_nodes_are_given_and_centroids_pruned():
    unit = np.random.default_rng(5)
    middles = unit.integers(-5000, 5000, (8, 6))
    tree = Tree.grown(np.concatenate([m + unit.integers(-50, 50, (300, 6)) for m in middles]))
    whole, _, open_ = tree.filtered(middles)
    assert open_.sum() == 0 and len(whole) < 64


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    run = con.execute(registry.oracle_sql()["op13_kd_means"])
    names = [c[0] for c in run.description]
    assert sorted(map(tuple, registry.op13_kd_means(spark, folder).select(*names).collect())) == sorted(run.fetchall())
