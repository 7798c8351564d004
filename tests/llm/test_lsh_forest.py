"""Near duplicates against brute force: links on full sets, components, crowded groups, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lsh_forest

from millrace.llm.lsh_forest import Forest, _shared_counts, components, near_duplicates


def sets(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    span = min(width, len(words))
    return frozenset(tuple(words[k : k + span]) for k in range(len(words) - span + 1))


def brute(rows, width, percent):
    shingles = {i: sets(t, width) for i, t in rows}
    up = {i: i for i in shingles}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(shingles)
    for a in ids:
        for b in ids:
            x, y = shingles[a], shingles[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(shingles[i]), root(i)) for i in ids}


def corpus(unit, groups, copies, words=60, edits=3):
    rows = []
    for _ in range(groups):
        base = [f"w{unit.randint(0, 5000)}" for _ in range(words)]
        for _ in range(unit.randint(1, copies)):
            own = list(base)
            for _ in range(unit.randint(0, edits)):
                own[unit.randrange(words)] = f"x{unit.randint(0, 10**6)}"
            rows.append(" ".join(own))
    unit.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rows = corpus(random.Random(width), 40, 8)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE "), (1005, "one two"), (1006, "two one"), (1007, "same " * 30000), (1008, "same " * 20)]
    df = spark.createDataFrame([(i, t, 0, False) for i, t in rows] + [(None, "one", 0, False), (1003, "one", 0, False)], "doc_id long, text string, n_shingles int, kept boolean")
    got = near_duplicates(df, Forest(width=width, percent=percent)).collect()
    want = brute(rows, width, percent)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_crowded_regions_and_clusters_lose_no_link(spark):
    """A crowd far below the groups' sizes: depth, parts and the second round all come into play."""
    unit = random.Random(9)
    rows = corpus(unit, 3, 1, 80, 0)
    base = rows[0][1].split()
    texts = [t for _, t in rows]
    for k in range(90):  # near copies of one text, some only near others
        own = list(base)
        for _ in range(2 + k % 7):
            own[unit.randrange(80)] = f"y{unit.randint(0, 10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, Forest(width=3, percent=85, crowd=8)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_crowded_region_of_texts_that_are_not_near_its_first_loses_no_link(spark):
    """Many texts share a long passage, so that they share prefixes of one value; only pairs of them are near."""
    unit = random.Random(4)
    passage = " ".join(f"p{unit.randint(0, 10**6)}" for _ in range(60))
    texts = []
    for _ in range(60):
        own = [f"z{unit.randint(0, 10**6)}" for _ in range(50)]
        texts.append(" ".join([passage, *own]))
        own[25] = "other"
        texts.append(" ".join([passage, *own]))
    unit.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Forest(width=3, percent=85, trees=4, depths=(1,), crowd=8)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}
    assert len(set(got.values())) == 60


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bulk_comparison_counts_what_is_shared():
    unit = np.random.default_rng(5)
    sets = [np.unique(unit.integers(0, 300, unit.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = np.nonzero(np.triu(np.ones((30, 30)), 1))
    mix = unit.permutation(len(i))
    i, j = i[mix], j[mix]
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    for columns in (64, 100, 1 << 19):
        assert _shared_counts(sets, i, j, columns).tolist() == want


def test_cluster_of_texts_that_are_nearly_near(spark):
    """Most pairs of a cluster are a little below the threshold, so the comparison in bulk comes into play."""
    unit = random.Random(12)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(4):
            own[unit.randrange(100)] = f"x{unit.randint(0, 10**6)}"
        texts += [" ".join(own)] + ([" ".join([*own[:99], "last"])] if unit.random() < 0.2 else [])
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, Forest(width=3, percent=85)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_crowd_beyond_all_windows_is_found_by_further_orders(spark):
    """Of 400 texts that share a third of their shingles, and 40 pairs that are near: recall 0.99 at least, here all,
    where a window holds two neighbours on either side."""
    unit = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(50))
    texts = []
    for k in range(400):
        own = [f"z{unit.randint(0, 10**7)}" for _ in range(50)]
        texts.append(" ".join([passage, *own]))
        if k < 40:
            own[49] = "other"
            texts.append(" ".join([passage, *own]))
    unit.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, Forest(width=3, percent=85, depths=(1, 16), crowd=8)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()} and len(set(got.values())) == 400


def test_two_texts_under_one_id_and_repeated_rows(spark):
    one = "a b c d e f g h i j k l m n o p"
    rows = [(5, one), (5, "quite another text that is near to none of the others at all"), (3, one + " q"), (5, one), (7, one)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, first int")
    got = near_duplicates(df, Forest(width=3, percent=80)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept, r.first) for r in got) == [(3, 3, True, True), (5, 3, False, False), (5, 3, False, False), (5, 5, True, True), (7, 3, False, False)]


@pytest.mark.parametrize("sizes", [(200, 200, 200), (200, 3, 200), (1, 200, 200, 200, 5), (200, 9, 1000), (30, 30, 30)])
def test_neighbours_over_borders_share_a_region(monkeypatch, sizes):
    """One crowded run over several partitions, also filling some of them whole: who stands side by side is in one region."""
    from types import SimpleNamespace

    import pyspark

    n, block, values = sum(sizes), 16, 4
    odd = lsh_forest._odd(1)
    labels = [(0).to_bytes(2, "big") + bytes(8) for _ in range(n)]
    together, begin = {}, 0
    for part, size in enumerate(sizes):
        monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls, part=part: SimpleNamespace(partitionId=lambda: part)))
        nodes = np.arange(begin, begin + size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            ties = (nodes * odd[0]).view(np.int64)
        batches = [pa.RecordBatch.from_arrays([pa.array(labels[at : at + 40][: size - at + begin], pa.binary()), pa.array(ties[at - begin : at - begin + 40])], names=["label", "tie"]) for at in range(begin, begin + size, 40)]
        for out in lsh_forest._regions_of(1, 2, block, values)(iter(batches)):
            for key, node in zip(out["key"].to_pylist(), out["node"].to_pylist(), strict=True):
                together.setdefault(key, set()).add(node)
        begin += size
    for k in range(n - 1):
        assert any({k, k + 1} <= of for of in together.values()), k
    assert max(map(len, together.values())) <= 4 * block + 3 * 9
