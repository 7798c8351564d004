"""Folds against a replay of the changes, one after another."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, fold

OPS = "pos long, op string, db string, tab string, pk long, value double, props string"


def changes(seed, n=400):
    unit = random.Random(seed)
    return [(k, unit.choice(["insert", "update", "update", "delete"]), "d", unit.choice("xy"), unit.randint(0, 12), unit.random(), f"p{k}") for k in range(n)]


def replay(rows, mode):
    table, refused = {}, []
    for pos, op, db, tab, pk, value, props in rows:
        key, there = (db, tab, pk), (db, tab, pk) in table
        if op == "delete":
            table.pop(key, None)
        elif mode == "replace" or (op == "insert" and (mode == "update" or not there)) or (op == "update" and there):
            table[key] = (value, props)
        elif op == "insert":
            refused.append(pos)
    return {(*k, *v) for k, v in table.items()}, refused


@pytest.mark.parametrize("seed", range(3))
def test_modes(spark, seed):
    rows = changes(seed)
    df = spark.createDataFrame(rows, OPS).repartition(3)
    for mode, run in (("replace", fold.replace), ("update", fold.update_only), ("insert", fold.insert_only)):
        assert {tuple(r) for r in run(df).collect()} == replay(rows, mode)[0]
    refused = {r.pos for r in fold.refused_inserts(df).collect()}
    assert refused <= set(replay(rows, "insert")[1])


def test_in_two_steps_and_twice(spark):
    df = spark.createDataFrame(changes(7), OPS)
    first = fold.replace(df.where("pos < 150"))
    both = fold.replace(fold.with_base(df.where("pos >= 150"), first))
    assert compare.same(both, fold.replace(df))
    assert compare.same(fold.replace(df.union(df)), fold.replace(df))


def test_moves(spark):
    rows = [(1, "insert", "d", "t", 1, 1.0, "a", None), (2, "update", "d", "t", 1, 2.0, "b", 5), (3, "update", "d", "t", 5, 3.0, "c", 5)]
    df = spark.createDataFrame(rows, OPS + ", new_pk long")
    assert [(r.pk, r.value) for r in fold.replace(fold.split_moves(df)).collect()] == [(5, 3.0)]
    assert sorted(r.pk for r in fold.replace(fold.split_moves(df, strict=False)).collect()) == [1, 5]


def replay_bag(rows):
    """rows: pos, op, (a, b), before. Null is equal to nothing."""
    table = []
    for _, op, row, before in rows:
        gone = row if op == "delete" else before if op == "update" else None
        if gone is not None and None not in gone:
            table = [x for x in table if x != gone]
        if op != "delete":
            table.append(row)
    return sorted(table, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_bags(spark, seed):
    unit = random.Random(seed)
    some = lambda: (unit.randint(1, 3), unit.choice(["x", "y", None]))
    rows = [(k, unit.choice(["insert", "insert", "update", "delete"]), some(), some()) for k in range(60)]
    df = spark.createDataFrame([(p, op, *row, before) for p, op, row, before in rows], "pos long, op string, a long, b string, before struct<a: long, b: string>").repartition(3)
    assert sorted((tuple(r) for r in fold.bag(df, ["a", "b"]).collect()), key=str) == replay_bag(rows)
    assert fold.bag(df, ["a", "b"], by_all_columns=False).count() == sum(op == "insert" for _, op, _, _ in rows)


@pytest.mark.parametrize("seed", range(4))
def test_partial_images(spark, seed):
    unit = random.Random(seed)
    rows = [(*r, {"value": unit.random() < 0.6, "props": unit.random() < 0.6}) for r in changes(seed, 200)]
    table, born = {}, set()
    for _, op, db, tab, pk, value, props, present in rows:
        key = (db, tab, pk)
        if op == "delete":
            table.pop(key, None)
            born.discard(key)
            continue
        held = table.setdefault(key, {"value": None, "props": None})
        held.update({c: v for c, v in (("value", value), ("props", props)) if present[c]})
        if op == "insert":
            born.add(key)
    got = fold.partial(spark.createDataFrame(rows, OPS + ", present map<string, boolean>").repartition(3)).collect()
    assert {tuple(r) for r in got} == {(*k, v["value"], v["props"]) for k, v in table.items() if k in born}


def test_emptied_tables(spark):
    ops = spark.createDataFrame([(k, "insert", d, t, k, 0.0, "") for k, (d, t) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("a", "x"), ("b", "y")])], OPS)
    said = spark.createDataFrame([(2, "ddl_truncate_table", "a", "x"), (1, "ddl_drop_table", "b", "x"), (9, "ddl_create_table", "a", "y"), (5, "ddl_drop_database", "b", "")], "pos long, kind string, db string, tab string")
    assert sorted(r.pos for r in fold.surviving(ops, said).collect()) == [1, 3]


def test_alerts_need_their_whole_time(spark):
    from millrace.operators import metrics

    unit = random.Random(3)
    at, samples = 0, []
    for _ in range(300):
        at += unit.choice([1, 1, 5, 20])
        samples.append(("d", at, unit.choice([20, 20, 20, 20, 20, 20, 20, 3])))
    began, want = None, []
    for _, second, delay in samples:
        began = None if delay - 1 < 10 else second if began is None else began
        want.append(began is not None and second - began >= 60)
    got = metrics.delay_alert(spark.createDataFrame(samples, "db string, second long, delay long")).orderBy("second").collect()
    assert [r.firing for r in got] == want and True in want
    two = spark.createDataFrame([("d", 1, 50), ("d", 2, 50)], "db string, second long, delay long")
    assert not any(r.firing for r in metrics.delay_alert(two).collect())


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k long, v string")
    assert {(r.k, r.status) for r in compare.by_key(a, b, ["k"]).collect()} == {(2, "differs"), (3, "missing"), (4, "extra")}
    assert compare.same(a, a.orderBy(F.desc("k"))) and not compare.same(a, a.union(a.limit(1)))
    one, other = (compare.table_hash(x, [F.col("k"), F.col("v")]).first() for x in (a, a.orderBy("v")))
    assert one == other
