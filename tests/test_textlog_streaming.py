"""Textual logs from files; streams against batches."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, fold
from millrace.operators.gtid import high_water
from millrace.sources import binlog_writer, oplog, textlog
from millrace.streaming import apply

FOLDER = "/root/testdata/sf0.001"

TEXT = """/*!50530 SET @@SESSION.PSEUDO_SLAVE_MODE=1*/;
DELIMITER /*!*/;
# at 4
#240520 12:34:56 server id 1  end_log_pos 126 CRC32 0x11111111 	Start: binlog v 4, server v 8.0.36
# at 126
#240520 12:34:57 server id 1  end_log_pos 205 CRC32 0x11111111 	GTID	last_committed=0	sequence_number=1	rbr_only=yes
SET @@SESSION.GTID_NEXT= '01234567-89ab-cdef-0123-456789abcdef:5'/*!*/;
# at 205
#240520 12:34:57 server id 1  end_log_pos 300 CRC32 0x11111111 	Table_map: `d`.`t` mapped to number 108
# at 300
#240520  9:34:57 server id 1  end_log_pos 400 CRC32 0x11111111 	Update_rows: table id 108 flags: STMT_END_F
### UPDATE `d`.`t`
### WHERE
###   @1=1 /* INT meta=0 nullable=0 is_null=0 */
###   @2=NULL
### SET
###   @1=1
###   @2='it''s'
### UPDATE `d`.`t`
### WHERE
###   @1=2
### SET
###   @1=3
# at 405
#240520 12:34:58 server id 1  end_log_pos 431 CRC32 0x11111111 	Xid = 10
COMMIT/*!*/;
"""


def test_text_files(spark, tmp_path):
    (tmp_path / "log.txt").write_text(TEXT)
    parsed = textlog.parse(textlog.read(spark, str(tmp_path))).cache()
    assert [r.event for r in parsed.orderBy("at").collect()] == ["Start", "GTID", "Table_map", "Update_rows", "Xid"]
    s = textlog.statistics(parsed).first()
    assert (s.update_rows, s.table_maps, s.commits, s.last_at) == (1, 1, 1, 405) and s.last_gtid.endswith(":5")
    assert [tuple(r) for r in textlog.table_statistics(parsed).collect()] == [("d", "t", 0, 1, 0)]
    assert [r.sql for r in textlog.statements(parsed, ["id", "v"]).orderBy("part").collect()] == ["UPDATE `d`.`t` SET `id` = 1, `v` = 'it''s' WHERE `id` = 1 AND `v` IS NULL", "UPDATE `d`.`t` SET `id` = 3 WHERE `id` = 2"]
    assert [(r.at, r.expected) for r in textlog.misplaced(parsed).collect()] == [(405, 400)]
    labels = spark.sql("select 'ENUM(''a'',''b,c'',''it''''s'')' as t").select(textlog.type_labels("t").alias("l")).first().l
    assert labels == ["a", "b,c", "it's"]


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartitionByRange(5, "event_id").write.parquet(f"{tmp_path}/in")
    ops = oplog.derived(apply.stream_table(spark, f"{tmp_path}/in", files_at_once=1))
    at = f"{tmp_path}/out"
    last = apply.run_available(ops, apply.apply_to(at, compact_every=2), f"{at}/checkpoint")
    assert last == 4
    want = fold.replace(oplog.derived(events))
    assert compare.same(apply.snapshot(spark, at, last, 2), want)
    marks = {tuple(r) for r in spark.read.parquet(f"{at}/marks/v={last}").collect()}
    batch = oplog.derived(spark.read.parquet(f"{tmp_path}/in")).where("pos < 100")
    for n in (5, 5, 6):  # what was applied before, again, and one batch twice
        apply.apply_to(at, compact_every=2)(batch.limit(0), n)
        assert compare.same(apply.snapshot(spark, at, n, 2), want)
    assert {tuple(r) for r in spark.read.parquet(f"{at}/marks/v=6").collect()} == marks


def test_applied_transactions_are_left_out(spark, tmp_path):
    ops = oplog.derived(spark.read.parquet(f"{FOLDER}/events.parquet"))
    sink, at = apply.apply_to(f"{tmp_path}/t", skip_applied=True), f"{tmp_path}/t"
    sink(ops.where("pos < 400"), 0)
    again = ops.where("pos < 200").withColumn("pos", ops.pos + 1_000_000)
    sink(again.union(ops.where("pos >= 400 and pos < 600")), 1)
    assert spark.read.parquet(f"{at}/changes/v=1").agg({"pos": "max"}).first()[0] < 600
    assert compare.same(apply.snapshot(spark, at, 1), fold.replace(ops.where("pos < 600")))


def test_fan_out(spark):
    got: list = []
    sink = apply.fan_out([lambda df, n: got.append(("a", df.count())), lambda df, n: got.append(("b", df.count()))])
    sink(spark.range(3), 0)
    assert got == [("a", 3), ("b", 3)]


def test_log_files_stream_from_three_starts(spark, tmp_path):
    row = "pk long, value double, props string"
    changes = [{"trx_no": k // 2, "server_uuid": "00000001-0000-4000-8000-000000000000", "trx_id": k // 2 + 1, "last_committed": k // 4, "db": "d", "tab": "t", "op": "insert" if k < 6 else "update", "pk": k % 6, "value": float(k), "props": f"p{k}", "ts": 1_700_000_000 + k} for k in range(12)]
    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(3):
        (logs / f"log.{n + 1:06d}").write_bytes(binlog_writer.write_changes(changes[4 * n : 4 * n + 4]))
        os.utime(logs / f"log.{n + 1:06d}", (1_700_000_000 + n,) * 2)

    def run(name, **start):
        at = f"{tmp_path}/{name}"
        sink = apply.of_logs(apply.apply_to(at, skip_applied=True), row, **start)
        last = apply.run_available(apply.stream_logs(spark, str(logs), files_at_once=1), sink, f"{at}/checkpoint")
        return {r.pk: r.value for r in apply.snapshot(spark, at, last).collect()}, last

    assert run("all") == ({k: float(k + 6) for k in range(6)}, 2)
    assert run("position", start=("log.000003", 4))[0] == {k: float(k + 6) for k in range(2, 6)}
    marks = spark.createDataFrame([("00000001-0000-4000-8000-000000000000", 5)], "server_uuid string, mark long")
    assert run("gtid", marks=marks)[0] == {4: 10.0, 5: 11.0}
    end = apply.log_end(spark, str(logs))
    assert end == ("log.000003", (logs / "log.000003").stat().st_size)
    (logs / "log.000004").write_bytes(binlog_writer.write_changes([changes[0] | {"trx_id": 7, "trx_no": 6, "value": 99.0}]))
    assert run("latest", start=end)[0] == {0: 99.0}


def test_destinations_skip_by_their_own_marks(spark, tmp_path):
    """Two destinations with different marks end alike, also after a batch that failed between them."""
    ops = oplog.read(spark, "/root/testdata/sf0.001")
    at, source = str(tmp_path), str(tmp_path / "log")
    first = ops.where("pos < 400")
    apply.apply_to(f"{at}/late")(first, 0)  # has had the first part
    marks = high_water(first).withColumn("destination", F.lit("late"))
    shifted = lambda sink: lambda batch, n: sink(batch, n + 1)
    failing = {"on": True}

    def late(batch, n):
        if failing.pop("on", False):
            raise RuntimeError("lost")
        shifted(apply.apply_to(f"{at}/late"))(batch, n)

    sink = apply.fan_out_each({"new": apply.apply_to(f"{at}/new"), "late": late}, at, marks)
    last = -1
    for lo, hi in ((0, 300), (300, 600), (600, 10**9)):
        ops.where(f"pos >= {lo} and pos < {hi}").coalesce(1).write.mode("append").parquet(source)
        if lo == 0:
            with pytest.raises(Exception, match="lost"):
                apply.run_available(apply.stream_table(spark, source), sink, f"{at}/c")
        last = max(last, apply.run_available(apply.stream_table(spark, source), sink, f"{at}/c"))
    rows = lambda df: sorted(map(tuple, df.select("db", "tab", "pk", "value", "props").collect()), key=repr)
    whole = rows(fold.replace(ops))
    assert rows(apply.snapshot(spark, f"{at}/new", last)) == whole == rows(apply.snapshot(spark, f"{at}/late", last + 1))
    assert spark.read.parquet(f"{at}/marks/v={last}").groupBy("server_uuid").agg(F.count_distinct("mark").alias("n"), F.count("*").alias("of")).select("n", "of").distinct().collect() == [(1, 2)]


def test_batches_of_logs_are_decoded_once(spark):
    """A sink reads its batch several times; what it reads is held."""
    seen = []
    sink = lambda batch, n: seen.append((batch.is_cached, batch.count(), n))
    apply.of_logs(sink, "pk long")(spark.createDataFrame([("log.000001", bytes(binlog_writer.MAGIC))], "path string, content binary"), 3)
    apply.of_text(sink, "id long")(textlog.write(oplog.read(spark, FOLDER)), 4)
    assert [(cached, n) for cached, _, n in seen] == [(True, 3), (True, 4)] and seen[0][1] == 0 and seen[1][1] > 0
