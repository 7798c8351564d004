"""A table in levels against one fold of all changes, and what a batch writes."""

import os

import pytest

from millrace.operators import compare, fold
from millrace.sources import oplog
from millrace.streaming import apply, leveled

FOLDER = "/root/testdata/sf0.001"
CHANGE = "pos long, op string, db string, tab string, pk long, value double, props string"


def ops_of(spark, rows):
    return spark.createDataFrame([(pos, op, "d", "t", pk, float(pos), None) for pos, op, pk in rows], CHANGE)


def written(at, number):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{at}/runs/v={number}") for f in fs if f.endswith(".parquet"))


def parts_written(at, number):
    return {name for _, names, _ in os.walk(f"{at}/runs/v={number}") for name in names if name.startswith("part=")}


def keys_of(spark, at, number, parts):
    return {r.pk: r.value for r in leveled.snapshot(spark, at, number, parts).collect()}


def test_equals_a_fold_after_every_batch(spark, tmp_path):
    ops, at = oplog.read(spark, FOLDER).cache(), f"{tmp_path}/t"
    sink = leveled.apply_leveled(at, parts=4, fanout=2)
    width = ops.count() // 6 + 1
    for n in range(6):
        sink(ops.where((ops.pos >= n * width) & (ops.pos < (n + 1) * width)), n)
        assert compare.same(leveled.snapshot(spark, at, n, 4), fold.replace(ops.where(ops.pos < (n + 1) * width)))
    runs = [tuple(r) for r in leveled.manifest(spark, at, 5).select("part", "level").collect()]
    assert len(runs) == len(set(runs))  # merged by twos, a part has one run of a level
    assert max(level for _, level in runs) == 2


def test_a_batch_writes_the_parts_it_touches(spark, tmp_path):
    at, base = f"{tmp_path}/t", 20_000
    sink = leveled.apply_leveled(at, parts=16, fanout=3)
    sink(spark.range(base).selectExpr("id as pos", "'insert' as op", "'d' as db", "'t' as tab", "id as pk", "cast(id as double) as value", "cast(null as string) as props"), 0)
    for n in range(1, 9):
        sink(ops_of(spark, [(base + n, "update", 7), (base + n, "update", 8)]), n)
        assert len(parts_written(at, n)) <= 2
    whole = written(at, 0)
    # The large runs of two parts are merged by batches 2 and 8, one level up each time; the others write their own rows, and 5 merges such.
    sizes = {n: written(at, n) for n in range(1, 9)}
    assert max(sizes.values()) < whole / 4 and [n for n in sizes if sizes[n] > whole / 20] == [2, 8]
    got = keys_of(spark, at, 8, 16)
    assert len(got) == base and got[7] == got[8] == base + 8
    assert {r.pk: r.value for r in leveled.find(spark, at, 8, ops_of(spark, [(0, "x", 8), (0, "x", 9), (0, "x", -1), (0, "x", None)]), 16).collect()} == {8: base + 8, 9: 9}


def test_deletes_go_where_nothing_older_is_left(spark, tmp_path):
    at = f"{tmp_path}/t"
    sink = leveled.apply_leveled(at, parts=1, fanout=2)
    sink(ops_of(spark, [(1, "insert", 1), (2, "insert", 2)]), 0)
    sink(ops_of(spark, [(3, "delete", 1)]), 1)  # merged to level 1: the delete is gone with its row
    assert [(r.level, r.rows) for r in leveled.manifest(spark, at, 1).collect()] == [(1, 1)]
    sink(ops_of(spark, [(4, "delete", 2)]), 2)
    sink(ops_of(spark, [(5, "insert", 3)]), 3)  # two merges: level 0 keeps the delete, level 1 ends it
    assert [(r.level, r.rows) for r in leveled.manifest(spark, at, 3).collect()] == [(2, 1)]
    assert keys_of(spark, at, 3, 1) == {3: 5}


def test_cut_short_and_run_again(spark, tmp_path):
    at = f"{tmp_path}/t"
    sink = leveled.apply_leveled(at, parts=2, fanout=2)
    batches = [[(1, "insert", 1), (2, "insert", 2)], [(3, "update", 1), (4, "delete", 2)], [(5, "insert", 2), (5, "insert", 3)]]
    for n, rows in enumerate(batches[:2]):
        sink(ops_of(spark, rows), n)
    before = keys_of(spark, at, 1, 2)
    # What a batch leaves behind that ends before its manifest.
    ops_of(spark, batches[2]).selectExpr("*", "0L as part").write.partitionBy("part").parquet(f"{at}/runs/v=2/level=0")
    assert keys_of(spark, at, 1, 2) == before == {1: 3}
    for _ in range(2):
        sink(ops_of(spark, batches[2]), 2)
        assert keys_of(spark, at, 2, 2) == {1: 3, 2: 5, 3: 5}
    assert leveled.drop_unused(spark, at, 2) >= 1
    assert keys_of(spark, at, 2, 2) == {1: 3, 2: 5, 3: 5} and os.listdir(f"{at}/manifest") == ["v=2"]
    sink(ops_of(spark, [(6, "delete", 1)]), 3)
    assert keys_of(spark, at, 3, 2) == {2: 5, 3: 5}


def test_empty_batches_null_keys_and_hot_keys(spark, tmp_path):
    at = f"{tmp_path}/t"
    sink = leveled.apply_leveled(at, parts=4)
    sink(ops_of(spark, []), 0)
    assert keys_of(spark, at, 0, 4) == {}
    sink(ops_of(spark, [(pos, "update", 5) for pos in range(1000)] + [(1001, "insert", None)]), 1)
    sink(ops_of(spark, []), 2)
    assert keys_of(spark, at, 2, 4) == {5: 999, None: 1001}
    assert sum(r.rows for r in leveled.manifest(spark, at, 2).collect()) == 2
    with pytest.raises(ValueError):
        leveled.apply_leveled(at, parts=8)(ops_of(spark, []), 3)


def test_behind_own_marks(spark, tmp_path):
    ops = oplog.read(spark, FOLDER)
    none = spark.createDataFrame([], "destination string, server_uuid string, mark long")
    sink = apply.fan_out_each({"t": leveled.apply_leveled(f"{tmp_path}/t", 4)}, str(tmp_path), none)
    sink(ops.where("pos < 400"), 0)
    sink(ops.where("pos < 800"), 1)  # the first half again
    assert compare.same(leveled.snapshot(spark, f"{tmp_path}/t", 1, 4), fold.replace(ops.where("pos < 800")))
    changed = spark.read.parquet(f"{tmp_path}/t/runs/v=1").agg({"pos": "min"}).first()[0]
    assert changed >= 400
