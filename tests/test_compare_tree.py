"""Comparison by checksums in a tree."""

import random

from pyspark.sql import functions as F

from millrace.operators import compare

ROW = "k long, g string, v string, x double"


def rows(n, seed=0):
    rng = random.Random(seed)
    return {(i, f"g{i % 3}"): (rng.choice([None, "a", "b"]), rng.choice([None, 0.5, 1.5])) for i in range(n)}


def frame(spark, table):
    return spark.createDataFrame([(*k, *v) for k, v in table.items()], ROW)


def test_same_rows_as_the_plain_join(spark):
    a = rows(600)
    b = {k: v for k, v in a.items() if k[0] % 50} | {(1000 + i, "g"): ("a", None) for i in range(7)}
    for i in range(1, 600, 40):
        b[i, f"g{i % 3}"] = ("c", a[i, f"g{i % 3}"][1])
    one, other = frame(spark, a), frame(spark, b)
    for levels in ((12, 10), (1,), (3, 3, 3)):
        got = compare.by_key_tree(one, other.select("x", "v", "g", "k"), ["k", "g"], levels)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compare.by_key(one, other, ["k", "g"]).collect()))


def test_values_that_change_places_with_nulls_differ(spark):
    one, other = (spark.createDataFrame([r], "k long, v string, w string") for r in ((1, "a", None), (1, None, "a")))
    assert [tuple(r) for r in compare.by_key_tree(one, other, ["k"]).collect()] == [(1, "differs")]


def test_equal_and_empty_tables(spark):
    one = frame(spark, rows(50))
    assert compare.by_key_tree(one, one, ["k", "g"]).count() == 0
    none = compare.by_key_tree(one.limit(0), one.limit(0), ["k", "g"])
    assert none.count() == 0 and none.columns == ["k", "g", "status"]
    assert compare.by_key_tree(one, one.limit(0), ["k", "g"]).where("status = 'missing'").count() == 50


def test_only_rows_under_differing_leaves_are_left(spark):
    one = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    other = one.withColumn("v", F.when(F.col("k") == 77, 0).otherwise(F.col("v")))
    nodes = compare.differing_nodes(one, other, ["k"], (6, 6))
    assert nodes.count() == 1 and compare.under(one, nodes, ["k"], 12).count() < 30
    assert [tuple(r) for r in compare.by_key_tree(one, other, ["k"], (6, 6)).collect()] == [(77, "differs")]
