"""Groups, gaps and order checks of streams against those of the whole log."""

import random
import time

import pytest

from millrace.operators import compare, gtid, transactions
from millrace.sources import oplog
from millrace.streaming import apply, group_log

FOLDER = "/root/testdata/sf0.001"
TRX = "kind string, pos long, trx_no long, server_uuid string, trx_id long, last_committed long, n_ops long"
S = ("s1", "s2")


def rows_of(spark, rows):
    """Rows of (trx_no, server, trx_id, last_committed); a number of heartbeats for an int."""
    every = [r for row in rows for r in ([("heartbeat", *[None] * 6)] * row if isinstance(row, int) else [("trx", row[0], *row, 1)])]
    return spark.createDataFrame(every, TRX)


def groups_of(spark, at, number, with_open=False):
    got = {}
    for r in group_log.groups(spark, at, number, with_open).collect():
        got.setdefault((r.gid, r.flush), []).append(r.trx_no)
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("cuts", [1, 7])
def test_however_the_log_is_cut(spark, tmp_path, cuts):
    rng, at = random.Random(cuts), str(tmp_path)
    trx = oplog.transactions(oplog.read(spark, FOLDER)).where("trx_id % 11 <> 3").selectExpr("'trx' as kind", "*").cache()
    ends = [-1, *sorted(rng.sample(range(240), cuts - 1)), 10_000]
    sink = group_log.apply_groups(at)
    for n in range(cuts):
        part = trx.where((trx.trx_no > ends[n]) & (trx.trx_no <= ends[n + 1]))
        sink(part, n)
    want = transactions.commit_groups(trx.drop("kind")).select("trx_no", "gid")
    assert compare.same(group_log.groups(spark, at, cuts - 1, with_open=True).select("trx_no", "gid"), want)
    assert compare.same(group_log.gaps(spark, at, cuts - 1), gtid.gaps(trx))
    assert group_log.late(spark, at, cuts - 1).isEmpty()
    marks = spark.read.parquet(f"{at}/marks/v={cuts - 1}")
    assert compare.same(marks, gtid.high_water(trx))


def test_one_file_a_batch(spark, tmp_path):
    """Six files of one transaction each, as six batches of a stream."""
    trx = oplog.transactions(oplog.read(spark, FOLDER)).where("trx_no < 6").selectExpr("'trx' as kind", "*").cache()
    for no in range(6):
        trx.where(trx.trx_no == no).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01)
    stream = apply.stream_table(spark, f"{tmp_path}/in", files_at_once=1)
    last = apply.run_available(stream, group_log.apply_groups(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    want = transactions.commit_groups(trx.drop("kind")).select("trx_no", "gid")
    assert last == 5 and compare.same(group_log.groups(spark, f"{tmp_path}/out", last, True).select("trx_no", "gid"), want)


def test_two_heartbeats_close_the_open_group(spark, tmp_path):
    at = str(tmp_path)
    sink = group_log.apply_groups(at)
    sink(rows_of(spark, [(1, "s1", 1, 0), (2, "s1", 2, 0)]), 0)
    sink(rows_of(spark, [1]), 1)
    assert groups_of(spark, at, 1) == {}
    sink(rows_of(spark, [(3, "s2", 1, 0), 1]), 2)  # work again: the count of heartbeats begins anew
    sink(rows_of(spark, [1]), 3)
    assert groups_of(spark, at, 3) == {} and groups_of(spark, at, 3, True) == {(1, None): [1, 2, 3]}
    for _ in range(2):  # the batch is run again
        sink(rows_of(spark, [1]), 4)
        assert groups_of(spark, at, 4) == {(1, "idle"): [1, 2, 3]}
    sink(rows_of(spark, [3]), 5)  # nothing is open
    sink(rows_of(spark, [(4, "s2", 2, 0), (5, "s1", 3, 7)]), 6)  # of the flushed group's last_committed, but behind the flush
    assert groups_of(spark, at, 6, True) == {(1, "idle"): [1, 2, 3], (2, "next"): [4], (3, None): [5]}
    sink(rows_of(spark, [2]), 7)
    assert groups_of(spark, at, 7, True) == {(1, "idle"): [1, 2, 3], (2, "next"): [4], (3, "idle"): [5]}


def test_late_and_repeated_transactions_are_reported(spark, tmp_path):
    at = str(tmp_path)
    sink = group_log.apply_groups(at)
    sink(rows_of(spark, [(10, "s1", 5, 0), (11, "s1", 9, 0), (12, "s2", 1, 0)]), 0)
    # Sent again, a gap that is filled, a file that came late with a number above its server's mark, one without a number.
    sink(rows_of(spark, [(13, "s1", 9, 0), (14, "s1", 7, 0), (9, "s2", 2, 0), (15, None, None, 0), (16, "s2", 4, 0)]), 1)
    got = sorted((r.trx_no, r.reason) for r in group_log.late(spark, at, 1).collect())
    assert got == [(9, "order"), (13, "again"), (14, "again")]
    assert sorted(map(tuple, group_log.gaps(spark, at, 1).collect())) == [("s1", 6, 8), ("s2", 2, 3)]
    assert groups_of(spark, at, 1, True) == {(1, None): [10, 11, 12, 15, 16]}


def test_barriers_and_empty_batches(spark, tmp_path):
    at = str(tmp_path)
    sink = group_log.apply_groups(at)
    sink(rows_of(spark, []).selectExpr("*", "false as barrier"), 0)
    assert groups_of(spark, at, 0, True) == {}
    sink(rows_of(spark, [(n, "s1", n, 0) for n in range(1, 6)]).selectExpr("*", "trx_no = 4 as barrier"), 1)
    sink(rows_of(spark, []).selectExpr("*", "false as barrier"), 2)
    sink(rows_of(spark, [(6, "s1", 6, 0)]).selectExpr("*", "true as barrier"), 3)
    assert groups_of(spark, at, 3, True) == {(1, "next"): [1, 2, 3], (2, "next"): [4, 5], (3, None): [6]}


def test_heartbeats_of_a_running_stream(spark, tmp_path):
    rows_of(spark, [(1, "s1", 1, 0), (2, "s1", 2, 0)]).drop("kind").write.parquet(f"{tmp_path}/in")
    log = group_log.with_heartbeats(apply.stream_table(spark, f"{tmp_path}/in"))
    at, seen = f"{tmp_path}/out", {"n": -1}
    own = group_log.apply_groups(at)

    def sink(batch, number):
        own(batch, number)
        seen["n"] = number

    query = log.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        until = time.time() + 90
        while time.time() < until and (seen["n"] < 0 or not groups_of(spark, at, seen["n"])):
            time.sleep(0.5)
    finally:
        query.stop()
    assert groups_of(spark, at, seen["n"]) == {(1, "idle"): [1, 2]}


def test_order_over_batches(spark, tmp_path):
    at = str(tmp_path)
    sink = group_log.check_order(at)
    entries = [(1, "gtid"), (2, "begin"), (3, "dml"), (4, "begin"), (5, "dml"), (6, "xid"), (8, "gtid"), (9, "xid")]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, kind string")
    for n, (a, b) in enumerate([(0, 2), (2, 2), (2, 5), (5, 7), (7, 8)]):
        sink(frame(entries[a:b]), n)
    want = transactions.order_violations(frame(entries))
    assert compare.same(group_log.violations(spark, at, 4), want) and want.count() == 2
    sink(frame([(7, "gtid"), (10, "gtid")]), 5)  # (10) stands behind the last of batch 4, not behind what came late
    late = {tuple(r) for r in group_log.violations(spark, at, 5).collect()} - {tuple(r) for r in want.collect()}
    assert late == {(7, "late", "gtid")}
