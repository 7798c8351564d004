"""Byte decoders and binary logs built by hand."""

import struct
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import rowbytes as rb
from millrace.plans import catalog
from millrace.sources import binlog
from millrace.sources.binlog_writer import Log, change_image, named, packed


@given(st.decimals(min_value=-(10**14), max_value=10**14, places=4, allow_nan=False))
def test_decimal_round_trip(x):
    assert rb.decimal(rb.Reader(rb.encode_decimal(x, 20, 4)), 20, 4) == x


@given(st.integers(0, 2**64 - 1))
def test_packed_integers(n):
    assert rb.Reader(packed(n)).packed() == n


def test_small_helpers():
    assert rb.Reader(b"\xfb").packed() is None
    assert rb.Reader(b"\x80\x01").varint() == 128
    with pytest.raises(ValueError):
        rb.Reader(b"\xff" * 6).varint()
    with pytest.raises(EOFError):
        rb.Reader(b"ab").take(3)
    assert [rb.bit_at(b"\x05", k) for k in range(4)] == [True, False, True, False] and rb.bit_count(b"\x05\x01") == 3


def test_times():
    packed_day = (2024 * 13 + 5) << 22 | 20 << 17 | 12 << 12 | 34 << 6 | 56
    raw = (packed_day + 0x8000000000).to_bytes(5, "big")
    assert rb.datetime2(rb.Reader(raw), 0) == datetime(2024, 5, 20, 12, 34, 56)
    assert rb.datetime2(rb.Reader(raw + b"\x0c"), 1) == datetime(2024, 5, 20, 12, 34, 56, 120000)
    assert rb.datetime2(rb.Reader((0x8000000000).to_bytes(5, "big")), 0) is None
    assert rb.date3(rb.Reader((2024 << 9 | 5 << 5 | 20).to_bytes(3, "little"))) == date(2024, 5, 20)
    clock = 838 << 12 | 59 << 6 | 59
    assert rb.time2(rb.Reader((clock + 0x800000).to_bytes(3, "big")), 0) == timedelta(hours=838, minutes=59, seconds=59)
    assert rb.time2(rb.Reader((0x800000 - clock).to_bytes(3, "big")), 0) == -timedelta(hours=838, minutes=59, seconds=59)
    assert rb.plain(-timedelta(hours=1, seconds=5)) == "-01:00:05"


def test_json_documents():
    # {"a": 1, "b": [true, "x"]} in the small form
    array = struct.pack("<HH", 2, 12) + b"\x04\x01\x00" + b"\x0c\x0a\x00" + b"\x01x"
    head = struct.pack("<HH", 2, 0) + struct.pack("<HHHH", 18, 1, 19, 1) + b"\x05\x01\x00" + b"\x02\x14\x00" + b"ab"
    assert rb.json_value(b"\x00" + head + array) == {"a": 1, "b": [True, "x"]}
    assert rb.json_value(b"") is None and rb.json_value(b"\x04\x00") is None and rb.json_value(b"\x0c\x02hi") == "hi"
    assert rb.json_value(b"\x0b" + struct.pack("<d", 1.5)) == 1.5
    dec = bytes([5, 2]) + rb.encode_decimal(Decimal("-1.25"), 5, 2)
    assert rb.json_value(b"\x0f\xf6" + bytes([len(dec)]) + dec) == "-1.25"


def wide_log():
    """A table with many types; an insert, an update and a delete."""
    log = Log(100)
    log.gtid("01234567-89ab-cdef-0123-456789abcdef", 7, 3, 4, 100)
    log.query("d", "BEGIN", 100)
    types = bytes([1, 3, 246, 247, 248, 16, 254, 252, 13, 15])
    meta = bytes([10, 2, 247, 1, 248, 1, 4, 0, 254, 40, 2]) + (300).to_bytes(2, "little")
    names = ["tiny", "num", "dec", "en", "st", "bits", "ch", "blob", "yr", "vc"]
    labels = lambda xs: packed(len(xs)) + b"".join(map(named, xs))
    extra = b"\x01\x01\x80" + b"\x05" + packed(len(labels(["p", "q", "r"]))) + labels(["p", "q", "r"]) + b"\x06" + packed(len(labels(["u", "v"]))) + labels(["u", "v"])
    extra += b"\x03" + packed(3) + packed(45) + packed(63) + packed(45)
    log.table_map(9, "d", "t", types, meta, names, [1], extra, 100)

    def image(tiny, num, en, st_):
        body = bytes([tiny]) + struct.pack("<i", num) + rb.encode_decimal(Decimal("-12.50"), 10, 2) + bytes([en, st_]) + b"\x05" + b"\x02hi" + b"\x02\x00\xff\x00" + b"\x7c" + b"\x02\x00" + "é".encode()
        return b"\x00\x00" + body

    log.rows(30, 9, 10, image(255, -5, 2, 5), 101)
    log.rows(31, 9, 10, image(1, -5, 1, 0) + image(2, -6, 0, 7), 102)
    log.rows(32, 9, 10, b"\xff\x03", 103)
    log.xid(77, 104)
    return log


def test_events_and_rows(spark):
    raw = wide_log().bytes()
    files = spark.createDataFrame([("x/log.1", bytearray(raw))], "path string, content binary")
    events = binlog.events(files)
    kinds = [r.kind for r in events.orderBy("pos").collect()]
    assert kinds == ["format_description", "gtid", "query", "table_map", "write_rows", "update_rows", "delete_rows", "xid"]
    assert all(r.checksum_ok for r in events.collect())
    said = {r.kind: r.details for r in binlog.with_details(events).collect()}
    assert '"query": "BEGIN"' in said["query"] and '"xid": 77' in said["xid"] and '"last_committed": 3' in said["gtid"]
    rows = binlog.oplog(events).orderBy("pos", "row_idx").collect()
    assert [(r.op, r.trx_id, r.server_uuid[:8], r.pk_cols) for r in rows] == [(op, 7, "01234567", ["num"]) for op in ("insert", "update", "delete")]
    assert rows[0].after == '{"tiny":255,"num":-5,"dec":"-12.50","en":"v","st":["p","r"],"bits":"0101","ch":"hi","blob":"ff00","yr":2024,"vc":"é"}'
    assert '"st":null' in rows[1].before and '"empty set"' in rows[1].none_sources and '"st":["p","q","r"]' in rows[1].after and '"en":""' in rows[1].after
    assert '"num":null' in rows[2].before


def test_broken_and_cut_files():
    raw = wide_log().bytes()
    damaged = bytearray(raw)
    damaged[-6] ^= 1
    assert [e["checksum_ok"] for e in binlog.split(bytes(damaged))][-1] is False
    assert len(list(binlog.split(raw[:-3]))) == 7
    with pytest.raises(ValueError):
        list(binlog.split(b"nope" + raw[4:]))


def test_map_before_rows_and_rotation(spark):
    log = Log(1)
    one = change_image(1, 1.0, "a")
    log.rows(30, 5, 3, one, 1)  # no map yet: dropped
    for name in ("old", "new"):
        log.table_map(5, "d", name, bytes([8, 5, 15]), bytes([8]) + (2000).to_bytes(2, "little"), ["pk", "value", "props"], [0], b"", 1)
        log.rows(30, 5, 3, one, 1)
    log.add(4, struct.pack("<Q", 4) + b"log.2", 1)
    log.rows(30, 5, 3, one, 1)  # ids are forgotten at a rotation
    events = binlog.events(spark.createDataFrame([("log.1", bytearray(log.bytes()))], "path string, content binary"))
    assert [r.tab for r in binlog.changes(binlog.mapped(events)).orderBy("pos").collect()] == ["old", "new"]
    assert [r.tab for r in binlog.changes(binlog.mapped(events, freeze=True)).orderBy("pos").collect()] == ["old", "old"]


def test_reading_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"log.{k}").write_bytes(wide_log().bytes())
    assert binlog.read(spark, str(tmp_path)).groupBy("src_file").count().count() == 3


def test_details_of_other_events():
    assert binlog.details("rotate", struct.pack("<Q", 4) + b"log.2") == {"position": 4, "next": "log.2"}
    assert binlog.details("rand", struct.pack("<QQ", 1, 2)) == {"seed1": 1, "seed2": 2}
    assert binlog.details("intvar", b"\x02" + struct.pack("<Q", 9)) == {"of": 2, "value": 9}
    sid = bytes(range(16))
    assert binlog.details("previous_gtids", struct.pack("<Q", 1) + sid + struct.pack("<QQQQQ", 2, 1, 6, 8, 9))["gtids"].endswith(":1-5:8")
    assert binlog.details("user_var", struct.pack("<I", 1) + b"n\x00" + b"\x02" + struct.pack("<II", 63, 8) + struct.pack("<q", -4) + b"\x00")["value"] == -4
    assert binlog.details("mariadb_gtid", struct.pack("<QI", 8, 1) + b"\x00") == {"domain": 1, "sequence": 8, "flags": 0}
    assert binlog.details("query", struct.pack("<IIBHH", 1, 0, 0, 0, 0) + b"\0a\xffb")["query"] == "a\\xffb"


def test_status_variables():
    raw = b"\x00" + struct.pack("<I", 5) + b"\x06\x03std" + b"\x04" + struct.pack("<HHH", 1, 2, 3) + b"\x0c\x02a\x00bc\x00" + b"\x0b\x01u\x01h" + b"\x63zz"
    assert binlog.status_variables(raw) == {"flags2": 5, "catalog_nz": "std", "charset": [1, 2, 3], "updated_db_names": ["a", "bc"], "invoker": ["u", "h"], "unknown_99": "7a7a"}
    body = struct.pack("<IIBHHIIIB", 1, 0, 1, 0, 0, 7, 2, 9, 1) + b"d\0load"
    assert binlog.details("execute_load_query", body)["query"] == "load"


def charset_map(types: bytes, meta: bytes, extra: bytes) -> dict:
    n = len(types)
    body = (7).to_bytes(6, "little") + b"\x01\x00\x01d\x00\x01t\x00" + packed(n) + types + packed(len(meta)) + meta + b"\xff" * ((n + 7) // 8)
    return binlog.table_map(body + extra)


def test_charsets_of_columns():
    text = (300).to_bytes(2, "little")
    one = charset_map(bytes([15, 15, 15, 15]), text * 4, b"\x03\x06" + bytes([8, 63, 28, 0xFC, 0xFF, 0]))
    assert [c["charset"] for c in one["columns"]] == ["cp1252", "binary", "gbk", "utf-8"]
    usual = charset_map(bytes([15, 15]), text * 2, b"\x02\x03" + bytes([33, 1, 54]))
    assert [c["charset"] for c in usual["columns"]] == ["utf-8", "utf-16-be"]
    image = lambda raw: b"\x00" + len(raw).to_bytes(2, "little") + raw
    for raw, at in (("é".encode("cp1252"), 8), ("é".encode(), 45), ("中".encode("gbk"), 28), ("é".encode("utf-16-be"), 54)):
        columns = charset_map(bytes([15]), text, b"\x03\x01" + bytes([at]))["columns"]
        assert rb.image(rb.Reader(image(raw)), columns, b"\x01")[0] == {"UNKNOWN_COL0": raw.decode(binlog.codec(at))}


def test_charsets_of_labels_and_years():
    labels = packed(1) + packed(1) + "é".encode("cp1252")
    got = charset_map(bytes([13, 1, 247]), bytes([247, 1]), b"\x01\x01\x40" + b"\x06" + packed(len(labels)) + labels + b"\x0b\x01\x08")
    year, tiny, kind = got["columns"]
    assert not year["unsigned"] and tiny["unsigned"] and kind["labels"] == ["é"]  # a year has a sign bit, too


def test_extra_data_of_row_events():
    head = (9).to_bytes(6, "little") + b"\x01\x00"
    assert binlog.extra_data("write_rows", head + b"\x02\x00rest") == {}
    assert binlog.extra_data("write_rows", head + b"\x05\x00\x01\x03\x00") == {"partition_id": 3}
    assert binlog.extra_data("update_rows", head + b"\x07\x00\x01\x03\x00\x04\x00") == {"partition_id": 3, "source_partition_id": 4}
    assert binlog.extra_data("delete_rows", head + b"\x07\x00\x00\x04\x00ab") == {"ndb_format": 0, "ndb_data": "6162"}


def test_files_of_a_task_do_not_grow_with_the_log(spark, monkeypatch):
    """24 files of 4,000 changes: a partition has about as many as it is given, however few partitions a shuffle has."""
    monkeypatch.setattr(catalog, "FILES_A_TASK", 2, raising=False)
    held = catalog._binlog_files(spark, "/root/testdata/sf0.1").select(F.spark_partition_id().alias("p"), "path").groupBy("p").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) == 25 and max(r.n for r in held) <= 4


def test_logs_are_read_in_one_pass(spark):
    """Rows of files meet their map and transaction as files are split: nothing is shuffled, and rows are those that events give."""
    one = change_image(1, 1.0, "a")
    log = wide_log()
    log.rows(30, 5, 3, one, 1)  # no map: dropped
    for tab in ("old", "new"):
        log.table_map(5, "d", tab, bytes([8, 5, 15]), bytes([8]) + (2000).to_bytes(2, "little"), ["pk", "value", "props"], [0], b"", 1)
        log.rows(30, 5, 3, one * 2, 1)
        log.gtid("01234567-89ab-cdef-0123-456789abcdef", 8, 3, 5, 1)
    log.add(4, struct.pack("<Q", 4) + b"log.2", 1)
    log.rows(30, 5, 3, one, 1)  # ids are forgotten at a rotation
    files = spark.createDataFrame([(f"x/log.{k}", bytearray(raw)) for k, raw in enumerate((log.bytes(), binlog.MAGIC, wide_log().bytes()))], "path string, content binary")
    got, want = binlog.oplog_of(files), binlog.oplog(binlog.events(files))
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert got.columns == want.columns and got.count() == 10 and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    last = binlog.oplog_of(files, last_only=True).collect()
    assert {(r.op, r.before is None, r.after is None) for r in last} == {("insert", True, False), ("update", True, False), ("delete", False, True)}


def test_decoded_rows_are_not_joined(spark):
    """Values, transaction and columns of a change come out of one pass over its file."""
    plan = catalog.binlog_decode(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan
