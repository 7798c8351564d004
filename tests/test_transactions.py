"""Commit groups flushed by count and by time, against a replay in order; counters of a small log."""

import random

from pyspark.sql import functions as F

from millrace.operators import metrics, transactions
from millrace.plans.search import first_reaching
from millrace.sources import oplog


def replay(rows, max_delay, max_count=None, clock=None):
    """An applier's loop over rows of (trx_no, gid, at) in order -> {trx_no: batch}."""
    out, group, applied, held, batch = {}, None, None, 0, 0
    for no, gid, at in rows:
        clock = at if clock is None else clock
        if held and (gid != group or (max_count and held >= max_count) or (applied is not None and applied - clock >= max_delay)):
            clock, held = applied, 0
        if not held:
            batch += 1
        group, applied, held = gid, at, held + 1
        out[no] = batch
    return out


KIND = "trx_no long, gid long, at long"


def test_the_clock_restarts_at_a_flush(spark):
    df = spark.createDataFrame([(k, 1, t) for k, t in enumerate((0, 15, 21, 24, 26))], KIND)
    got = {r.at: r.batch for r in transactions.flushed_groups(df, 10, clock=0).collect()}
    assert got == {0: 1, 15: 1, 21: 2, 24: 2, 26: 2}


def test_flushes_are_those_of_a_replay(spark):
    for seed, size, delay, count, back in ((1, 40, 50, 3, 60), (2, 1, 5, None, 0), (3, 700, 30, None, 500), (4, 700, 40, 7, 5), (5, 90, 10**9, None, 60), (6, 700, 1, 1, 0)):
        unit = random.Random(seed)
        # Numbers far apart stand in different buckets of the order; times go back now and then.
        rows = [(k * 400_000, k // size, 1000 + 7 * k + unit.choice((0, 0, 0, -back))) for k in range(700)]
        df = spark.createDataFrame(rows, KIND)
        got = transactions.flushed_groups(df, delay, count).collect()
        assert {r.trx_no: r.batch for r in got} == replay(rows, delay, count), seed
    assert transactions.flushed_groups(df.limit(0), 10).collect() == []


def test_workers_take_turns(spark):
    rows = [(k * 400_000, k // 40, 0) for k in range(120)]
    for r in transactions.schedule(spark.createDataFrame(rows, KIND), 4).collect():
        assert r.worker == (r.trx_no // 400_000) % 40 % 4


def test_first_reaching_against_a_scan(spark):
    unit = random.Random(9)
    values = [None if unit.random() < 0.1 else unit.randrange(1000) for _ in range(400)]
    rows = [(k, v, unit.randrange(430), unit.choice((None, unit.randrange(1100)))) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, v long, b long, t long")
    for width in (4, 7, 256):
        got = {r.i: r.found for r in first_reaching(df, "i", "v", F.col("b"), F.col("t"), "found", width).collect()}
        want = {k: next((j for j in range(b, 400) if t is not None and values[j] is not None and values[j] >= t), None) for k, _, b, t in rows}
        assert got == want


def test_counters_of_an_empty_log(spark):
    ops = oplog.derived(spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    named = spark.createDataFrame([], "kind string, db string")
    groups = transactions.commit_groups(oplog.transactions(ops))
    one = metrics.replication_counters(ops, named, groups, F.lit(True)).first()
    assert one.delay is None and all(v == 0 for k, v in one.asDict().items() if k != "delay")
    assert set(metrics.operation_counters(ops, named, F.lit(True), F.lit(True)).first()) == {0}
