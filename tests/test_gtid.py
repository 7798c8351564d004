"""Interval algebra against sets of numbers."""

import bisect
import random

from pyspark.sql import functions as F

from millrace.operators import gtid

U = ["0000000{}-0000-4000-8000-000000000000".format(k) for k in range(3)]


def sets(spark, numbers):
    return gtid.intervals(spark.createDataFrame([(u, n) for u, ns in numbers.items() for n in ns], "server_uuid string, trx_id long"))


def numbers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.server_uuid, set()).update(range(r.s, r.e + 1))
    return out


def test_algebra(spark):
    unit = random.Random(3)
    a = {u: {unit.randint(1, 60) for _ in range(30)} for u in U[:2]}
    b = {u: {unit.randint(1, 60) for _ in range(30)} for u in U[1:]}
    x, y = sets(spark, a), sets(spark, b)
    pick = lambda f: {u: v for u in U if (v := f(a.get(u, set()), b.get(u, set())))}
    assert numbers(x) == a
    assert numbers(gtid.union(x, y)) == pick(set.union)
    assert numbers(gtid.subtract(x, y)) == pick(set.difference)
    assert numbers(gtid.intersect(x, y)) == pick(set.intersection)
    for df in (x, gtid.union(x, y), gtid.subtract(x, y)):  # no two intervals touch
        rows = sorted(map(tuple, df.select("server_uuid", "s", "e").collect()))
        assert all(p[0] != q[0] or p[2] + 1 < q[1] for p, q in zip(rows, rows[1:]))


def test_text_round_trip_and_bad_parts(spark):
    x = sets(spark, {U[0]: {1, 2, 3, 7}, U[1]: {5}})
    text = gtid.interval_text(x)
    assert {r.gtid for r in text.collect()} == {U[0] + ":1-3:7", U[1] + ":5"}
    assert numbers(gtid.parse(text.select("gtid"))) == {U[0]: {1, 2, 3, 7}, U[1]: {5}}
    bad = spark.createDataFrame([(t,) for t in ("", U[0], U[0] + ":", U[0] + ":a", U[0] + ":3-1", U[0] + ":1-2-3", U[0] + ":99999999999999999999")], "gtid string")
    assert not any(r.valid for r in gtid.parse(bad).collect())
    two = spark.createDataFrame([(f"{U[0]}:1-2, {U[1].upper()}:4",)], "gtid string")
    assert numbers(gtid.parse(two)) == {U[0]: {1, 2}, U[1]: {4}}


def test_merges(spark):
    rows = [("d1", U[0], 5), ("d1", U[1], 9), ("d2", U[0], 3)]
    df = spark.createDataFrame(rows, "destination string, server_uuid string, mark long")
    all_ = spark.createDataFrame([("d1",), ("d2",)], "destination string")
    assert {(r.server_uuid, r.mark) for r in gtid.merge_min(df, all_).collect()} == {(U[0], 3), (U[1], 9)}
    more = all_.union(spark.createDataFrame([("d3",)], "destination string"))
    assert gtid.merge_min(df, more).collect() == []  # one has nothing: all start anew


def test_dedup_and_gaps(spark):
    rows = [(U[0], 1, 1), (U[0], 2, 2), (U[0], 2, 3), (U[0], 1, 4), (U[0], 5, 5), (U[1], 40, 6)]
    df = spark.createDataFrame(rows, "server_uuid string, trx_id long, pos long")
    assert sorted(r.pos for r in gtid.first_seen(df).collect()) == [1, 2, 5, 6]
    assert [(r.missing_from, r.missing_to) for r in gtid.gaps(df).collect()] == [(3, 4)]
    done = spark.createDataFrame([(U[0], 1, 2)], "server_uuid string, s long, e long")
    assert sorted(r.pos for r in gtid.excluding(df, done).collect()) == [5, 6]
    assert [(r.server_uuid, r.contained) for r in gtid.contains(gtid.intervals(df), done).collect()] == [(U[0], True)]


def test_start_marks(spark):
    kind = "server_uuid string, mark long"
    empty, stored, configured = (spark.createDataFrame(x, kind) for x in ([], [(U[0], 5)], [(U[0], 1), (U[1], 2)]))
    assert [tuple(r) for r in gtid.start_marks(stored, configured).collect()] == [(U[0], 5)]
    assert gtid.start_marks(empty, configured).count() == 2


def test_lookups_against_sets_of_numbers(spark):
    """20,000 intervals, most of one server, far beyond a bucket of the order."""
    unit = random.Random(6)

    def set_of(n, step):
        at, out = 0, []
        for _ in range(n):
            s = at + 2 + unit.randrange(step)
            at = s + unit.randrange(step)
            out.append(("a" if unit.random() < 0.9 else "b", s, at))
        return out

    one, other = set_of(20_000, 300), set_of(6_000, 900)
    kind = "server_uuid string, s long, e long"
    mine = {u: sorted((s, e) for v, s, e in one if v == u) for u in "ab"}

    def reach(u, n):
        k = bisect.bisect_right(mine[u], (n, 1 << 60)) - 1
        return mine[u][k][1] if k >= 0 else -1

    a, b = spark.createDataFrame(one, kind), spark.createDataFrame(other, kind)
    got = {tuple(r) for r in gtid.overlapping(b, a).collect()}
    assert got == {(u, s, e) for u, s, e in other if reach(u, e) >= s}
    assert {r.server_uuid: r.contained for r in gtid.contains(a, b.limit(0).union(a.where("s % 2 = 0"))).collect()} == {"a": True, "b": True}
    assert {r.server_uuid: r.contained for r in gtid.contains(a, b).collect()} == {u: all(reach(u, s) >= e for v, s, e in other if v == u) for u in "ab"}
    points = [(k, unit.choice(["a", "b", "c", None]), unit.choice([None, *[unit.randrange(6_000_000) for _ in range(5)]])) for k in range(5_000)]
    ops = spark.createDataFrame(points, "pos long, server_uuid string, trx_id long")
    kept = {r.pos for r in gtid.excluding(ops, a).collect()}
    assert kept == {k for k, u, n in points if u not in mine or n is None or reach(u, n) < n}
    numbers = lambda df: {(r.server_uuid, n) for r in df.collect() for n in range(r.s, r.e + 1)}
    small, large = a.where("s < 60000"), b.where("s < 60000")
    x, y = numbers(small), numbers(large)
    assert numbers(gtid.union(small, large)) == x | y and numbers(gtid.subtract(small, large)) == x - y and numbers(gtid.intersect(small, large)) == x & y


def test_text_of_many_intervals(spark):
    """As many as no stack of a pattern holds, and one that is wrong behind them."""
    n = 200_000
    of = spark.range(n).select(F.lit(U[0]).alias("server_uuid"), (3 * F.col("id") + 1).alias("s"), (3 * F.col("id") + 1 + F.col("id") % 2).alias("e"))
    text = gtid.interval_text(of).select("gtid")
    parsed = gtid.parse(text.union(text.select(F.concat("gtid", F.lit(":x")))))
    assert parsed.where("valid").select("server_uuid", "s", "e").exceptAll(of).count() == 0
    assert [tuple(r) for r in parsed.groupBy("valid").count().orderBy("valid").collect()] == [(False, 1), (True, n)]
