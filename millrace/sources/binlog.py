"""Binary logs: files to events, events to row changes.

A file is split into events by one task (files are the unit of parallel reading, as the server rotates them at a
bounded size). Events stay bytes until something is asked of them: types and tables are filtered
first, and only the row events that are left meet their table map and are decoded.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rowbytes import Reader, as_json, bit_at, column_types, image
from millrace.plans.ordered import with_running
from millrace.plans.shared import kept

# Event types by code, and the magic bytes of a file.
MAGIC = b"\xfebin"
EVENTS = {
    2: "query", 3: "stop", 4: "rotate", 5: "intvar", 13: "rand", 14: "user_var", 15: "format_description", 16: "xid",
    17: "begin_load_query", 18: "execute_load_query", 19: "table_map", 23: "write_rows", 24: "update_rows", 25: "delete_rows",
    27: "heartbeat", 29: "rows_query", 30: "write_rows", 31: "update_rows", 32: "delete_rows", 33: "gtid", 34: "anonymous_gtid",
    35: "previous_gtids", 38: "xa_prepare", 39: "partial_update_rows", 160: "annotate_rows", 161: "binlog_checkpoint",
    162: "mariadb_gtid", 163: "mariadb_gtid_list", 164: "start_encryption",
}
ROWS = ("write_rows", "update_rows", "delete_rows", "partial_update_rows")

_EVENT = pa.schema([("src_file", pa.string()), ("pos", pa.int64()), ("ts", pa.int64()), ("type", pa.int32()), ("kind", pa.string()), ("server_id", pa.int64()), ("size", pa.int64()), ("end_pos", pa.int64()), ("flags", pa.int32()), ("body", pa.binary()), ("checksum_ok", pa.bool_())])
EVENT_TYPES = "src_file string, pos long, ts long, type int, kind string, server_id long, size long, end_pos long, flags int, body binary, checksum_ok boolean"


_HEADER = struct.Struct("<IBIIIH")
_BATCH_ROWS, _BATCH_BYTES = 5000, 8 << 20


def split(content: bytes, name: str = "") -> Iterator[dict]:
    """Events of one file. A broken checksum is told, not dropped; a cut-off last event ends the file."""
    return (dict(zip(_EVENT.names, e, strict=True)) for e in _split(content, name))


def _split(content: bytes, name: str, checked: bool = True) -> Iterator[tuple]:
    if content[:4] != MAGIC:
        raise ValueError(f"{name}: not a binary log")
    at, checksums = 4, True
    while at + 19 <= len(content):
        ts, kind, server, size, end, flags = _HEADER.unpack_from(content, at)
        if size < 19:
            raise ValueError(f"{name}: an event of {size} bytes at {at}")
        if at + size > len(content):
            return
        if kind == 15:
            checksums = content[at + size - 5] == 1
        tail = 4 if checksums or kind == 15 else 0
        body = content[at + 19 : at + size - tail]
        ok = zlib.crc32(content[at : at + size - 4]) == int.from_bytes(content[at + size - 4 : at + size], "little") if tail and checked else None
        yield name, at, ts, kind, EVENTS.get(kind, "unknown"), server, size, end, flags, body, ok
        at += size


def events(files: DataFrame) -> DataFrame:
    """Events of files (path, content), as spark.read.format("binaryFile") gives them. The files of a partition may be one batch in a
    task's memory: a source packs them by size, and what makes files of its own has to deal them to as many partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows: list[tuple] = []
                size = 0
                for e in _split(content.as_py(), path.rsplit("/", 1)[-1]):
                    rows.append(e)
                    size += e[6]
                    if len(rows) == _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield _batch(rows, _EVENT)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _EVENT)

    return files.select("path", "content").mapInArrow(run, EVENT_TYPES)


def read(spark: SparkSession, path: str) -> DataFrame:
    return events(spark.read.format("binaryFile").load(path))


# Status variables of a query by key, and their sizes in bytes (parts of a variable one after another).
_STATUS = {
    0: ("flags2", 4), 1: ("sql_mode", 8), 3: ("auto_increment", 2, 2), 4: ("charset", 2, 2, 2), 7: ("lc_time_names", 2), 8: ("charset_database", 2),
    9: ("table_map_for_update", 8), 10: ("master_data_written", 4), 13: ("microseconds", 3), 16: ("explicit_defaults_for_timestamp", 1),
    17: ("ddl_logged_with_xid", 8), 18: ("default_collation_for_utf8mb4", 2), 19: ("sql_require_primary_key", 1), 20: ("default_table_encryption", 1),
    128: ("hrnow", 3), 129: ("xid", 8),
}


def status_variables(raw: bytes) -> dict:
    """Status variables of a query; what follows an unknown key is kept as it is."""
    r, out = Reader(raw), {}
    while r.left():
        key = r.uint(1)
        if key in _STATUS:
            name, *sizes = _STATUS[key]
            parts = [r.uint(n) for n in sizes]
            out[name] = parts[0] if len(parts) == 1 else parts
        elif key in (2, 5, 6):
            out[{2: "catalog", 5: "time_zone", 6: "catalog_nz"}[key]] = r.text(r.uint(1))
            if key == 2:
                r.take(1)
        elif key == 11:
            out["invoker"] = [r.text(r.uint(1)), r.text(r.uint(1))]
        elif key == 12:
            n, names = r.uint(1), []
            for _ in range(0 if n == 254 else n):
                end = r.data.index(b"\0", r.at)
                names.append(r.text(end - r.at))
                r.take(1)
            out["updated_db_names"] = names
        else:
            out[f"unknown_{key}"] = r.take(r.left()).hex()
    return out


def details(kind: str, body: bytes, server_version: tuple[int, ...] = (8, 0)) -> dict:
    """What an event other than a row event says."""
    r = Reader(body)
    if kind == "query":
        thread, seconds, n, error, status = r.uint(4), r.uint(4), r.uint(1), r.uint(2), r.uint(2)
        known = status_variables(r.take(status))
        schema = r.text(n)
        r.take(1)
        return {"thread_id": thread, "seconds": seconds, "error": error, "schema": schema, "status": known, "query": r.take(r.left()).decode("utf-8", "backslashreplace")}
    if kind == "rotate":
        return {"position": r.uint(8), "next": r.text(r.left())}
    if kind == "format_description":
        return {"version": r.uint(2), "server_version": r.take(50).rstrip(b"\0").decode(), "created": r.uint(4)}
    if kind == "xid":
        return {"xid": r.uint(8)}
    if kind in ("gtid", "anonymous_gtid"):
        out = {"commit_flag": r.uint(1), "server_uuid": str(uuid.UUID(bytes=r.take(16))), "trx_id": r.uint(8)}
        if r.left() >= 17 and r.uint(1) == 2:
            out |= {"last_committed": r.uint(8), "sequence_number": r.uint(8)}
        return out
    if kind == "previous_gtids":
        sets = []
        for _ in range(r.uint(8)):
            sid = str(uuid.UUID(bytes=r.take(16)))
            spans = [(r.uint(8), r.uint(8) - 1) for _ in range(r.uint(8))]
            sets.append(sid + "".join(f":{a}" if a == b else f":{a}-{b}" for a, b in spans))
        return {"gtids": ",".join(sets)}
    if kind == "heartbeat":
        return {"file": r.text(r.left())}
    if kind == "intvar":
        return {"of": r.uint(1), "value": r.uint(8)}
    if kind == "rand":
        return {"seed1": r.uint(8), "seed2": r.uint(8)}
    if kind == "rows_query":
        r.take(1)
        return {"query": r.text(r.left())}
    if kind == "annotate_rows":
        return {"query": r.text(r.left())}
    if kind == "user_var":
        name = r.text(r.uint(4))
        if r.uint(1):
            return {"name": name, "value": None}
        of, charset = r.uint(1), r.uint(4)
        raw = r.take(r.uint(4))
        flag = r.uint(1) if r.left() else 0
        number = int.from_bytes(raw, "little", signed=not flag & 1)
        known = {0: lambda: raw.decode("utf-8", "replace"), 1: lambda: struct.unpack("<d", raw)[0], 2: lambda: number}
        return {"name": name, "of": of, "charset": charset, "value": known.get(of, raw.hex)()}
    if kind == "xa_prepare":
        one, form, a, b = r.uint(1), r.uint(4), r.uint(4), r.uint(4)
        return {"one_phase": bool(one), "format": form, "gtrid": r.take(a).hex(), "bqual": r.take(b).hex()}
    if kind == "execute_load_query":
        thread, seconds, n, error, status = r.uint(4), r.uint(4), r.uint(1), r.uint(2), r.uint(2)
        file_id, start, end, duplicates = r.uint(4), r.uint(4), r.uint(4), r.uint(1)
        known = status_variables(r.take(status))
        schema = r.text(n)
        r.take(1)
        return {"thread_id": thread, "seconds": seconds, "error": error, "file_id": file_id, "start": start, "end": end, "duplicates": duplicates, "schema": schema, "status": known, "query": r.text(r.left())}
    if kind == "begin_load_query":
        return {"file_id": r.uint(4), "block": r.take(r.left()).hex()}
    if kind == "mariadb_gtid":
        n, domain = r.uint(8), r.uint(4)
        return {"domain": domain, "sequence": n, "flags": r.uint(1)}
    if kind == "mariadb_gtid_list":
        n = r.uint(4) & 0x0FFFFFFF
        return {"gtids": ",".join("{}-{}-{}".format(r.uint(4), r.uint(4), r.uint(8)) for _ in range(n))}
    if kind == "binlog_checkpoint":
        return {"file": r.text(r.uint(4))}
    if kind == "start_encryption":
        return {"scheme": r.uint(1), "key_version": r.uint(4), "nonce": r.take(12).hex()}
    if kind == "table_map":
        return table_map(body)
    return {}


# Collation ids by codec.
_CODECS = {
    "binary": (63,), "ascii": (11, 65), "big5": (1, 84), "cp1250": (26, 34, 44, 66, 99), "cp1251": (14, 23, 50, 51, 52), "cp1252": (5, 8, 15, 31, 47, 48, 49, 94),
    "cp1256": (57, 67), "cp1257": (29, 58, 59), "cp850": (4, 80), "cp852": (40, 81), "cp866": (36, 68), "cp932": (95, 96), "euc_jp": (12, 91, 97, 98),
    "euc_kr": (19, 85), "gb18030": range(248, 251), "gb2312": (24, 86), "gbk": (28, 87), "iso8859_2": (2, 9, 21, 27, 77), "iso8859_7": (25, 70), "iso8859_8": (16, 71),
    "iso8859_9": (30, 78), "iso8859_13": (20, 41, 42, 79), "koi8_r": (7, 74), "koi8_u": (22, 75), "mac_latin2": (38, 43), "mac_roman": (39, 53), "shift_jis": (13, 88),
    "tis_620": (18, 89), "utf-16-be": (35, 54, 55, 90, *range(101, 125), *range(128, 152), 159), "utf-16-le": (56, 62), "utf-32-be": (60, 61, *range(160, 184)),
}
_CODEC = {n: codec for codec, ids in _CODECS.items() for n in ids}


def codec(collation: int) -> str:
    """The codec of a collation id; all that is named nowhere else is a form of utf-8."""
    return _CODEC.get(collation, "utf-8")


def table_map(body: bytes) -> dict:
    """table_id, db, tab and columns, with what the optional metadata says of names, signs, keys, charsets and labels."""
    r = Reader(body)
    out = {"table_id": r.uint(6)}
    r.take(2)
    out["db"] = r.text(r.uint(1))
    r.take(1)
    out["tab"] = r.text(r.uint(1))
    r.take(1)
    n = r.packed()
    types = r.take(n)
    columns = column_types(types, r.take(r.packed()))
    r.take((n + 7) // 8)
    numeric = [c for c in columns if c["type"] in (1, 2, 3, 4, 5, 8, 9, 13, 246)]
    texts = [c for c in columns if c["type"] in (15, 252, 253, 254)]
    labelled = [c for c in columns if c["type"] in (247, 248)]
    while r.left() > 1:
        tag = r.uint(1)
        own = Reader(r.take(r.packed()))
        if tag == 1:
            raw = own.data
            for k, c in enumerate(numeric):
                c["unsigned"] = bool(raw[k >> 3] >> (7 - (k & 7)) & 1)
        elif tag in (2, 10):  # one collation for all, and those that have another
            of = texts if tag == 2 else labelled
            usual = own.packed()
            for c in of:
                c["charset"] = codec(usual)
            while own.left():
                k, other = own.packed(), own.packed()
                of[k]["charset"] = codec(other)
        elif tag in (3, 11):
            for c in texts if tag == 3 else labelled:
                c["charset"] = codec(own.packed())
        elif tag == 7:
            for c in (c for c in columns if c["type"] == 255):
                c["geometry"] = own.packed()
        elif tag == 4:
            for c in columns:
                c["name"] = own.text(own.packed())
        elif tag in (5, 6):
            for c in (c for c in columns if c["type"] == (248 if tag == 5 else 247)):
                c["labels"] = [own.take(own.packed()) for _ in range(own.packed())]
        elif tag in (8, 9):
            while own.left():
                columns[own.packed()]["primary"] = True
                if tag == 9:
                    own.packed()
        elif tag == 12:
            for k, c in enumerate(columns):
                c["visible"] = bool(own.data[k >> 3] >> (7 - (k & 7)) & 1)
    for c in labelled:  # their charset comes after them
        if "labels" in c:
            c["labels"] = [x.decode(c.get("charset", "utf-8") if c.get("charset") != "binary" else "utf-8", "replace") for x in c["labels"]]
    out["columns"] = columns
    return out


def with_details(of: DataFrame) -> DataFrame:
    """Events with details, a JSON object (null for row events)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [None if k in ROWS or k == "unknown" else json.dumps(details(k, x)) for k, x in zip(b["kind"].to_pylist(), b["body"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "details"])

    return of.mapInArrow(run, f"{EVENT_TYPES}, details string")


def _table_id() -> Column:
    """The first six bytes of a body, a little-endian number."""
    h = F.hex(F.substring("body", 1, 6))
    return F.conv(F.concat(*(F.substring(h, k, 2) for k in range(11, 0, -2))), 16, 10).cast("long")


def mapped(of: DataFrame, freeze: bool = False) -> DataFrame:
    """Row events with the table map that holds for them: the last one of their table id before
    them in the file, since its last rotation; freeze: the first there was. Rows without a map are dropped.

    What is put in order are positions, in buckets; bodies of rows stay out of it and meet their map by its position.
    """
    some = of.where(F.col("kind").isin("table_map", *ROWS)).withColumn("table_id", _table_id())
    turns = of.where((F.col("kind") == "rotate") & (F.col("ts") > 0)).select("src_file", "pos", F.lit(1).alias("_turn"))
    places = some.select("src_file", "pos", "table_id", F.lit(0).alias("_turn"), (F.col("kind") == "table_map").alias("_is")).unionByName(turns, allowMissingColumns=True)
    placed = with_running(places, "pos", F.col("_turn").cast("long"), "_gen", ["src_file"]).where("_turn = 0")
    by = ["src_file", "_gen", "table_id"]
    at = with_running(placed, "pos", F.when(F.col("_is"), F.col("pos")), "_at", by, "max").where("not _is and _at is not null")
    if freeze:
        first = placed.where("_is").groupBy(*by).agg(F.min("pos").alias("_first"))
        at = at.join(first, by).withColumn("_at", F.col("_first"))
    maps = some.where(F.col("kind") == "table_map").select("src_file", F.col("pos").alias("_at"), F.col("body").alias("map"))
    known = at.select("src_file", "pos", "_at").join(maps, ["src_file", "_at"]).drop("_at")
    return some.where(F.col("kind").isin(*ROWS)).join(known, ["src_file", "pos"])


_ROW = pa.schema([("src_file", pa.string()), ("pos", pa.int64()), ("row_idx", pa.int32()), ("ts", pa.int64()), ("db", pa.string()), ("tab", pa.string()), ("op", pa.string()), ("pk_cols", pa.list_(pa.string())), ("before", pa.string()), ("after", pa.string()), ("none_sources", pa.string()), ("extra", pa.string())])
ROW_TYPES = "src_file string, pos long, row_idx int, ts long, db string, tab string, op string, pk_cols array<string>, before string, after string, none_sources string, extra string"


def extra_data(kind: str, body: bytes) -> dict:
    """What a row event of the second version says besides its rows: partitions, or what an NDB engine adds."""
    r = Reader(body, 8)
    own = Reader(r.take(r.uint(2) - 2))
    out: dict = {}
    while own.left():
        if own.uint(1) == 0:
            size, form = own.uint(1), own.uint(1)
            out |= {"ndb_format": form, "ndb_data": own.take(max(0, size - 2)).hex()}
        elif kind in ("update_rows", "partial_update_rows"):
            out |= {"partition_id": own.uint(2), "source_partition_id": own.uint(2)}
        else:
            out["partition_id"] = own.uint(2)
    return out


def decode_rows(kind: str, code: int, body: bytes, columns: list[dict]) -> Iterator[tuple[dict | None, dict | None, dict]]:
    """(before, after, reasons of nulls) for every row of a row event."""
    r = Reader(body, 8)
    if code >= 30:
        r.take(r.uint(2) - 2)
    n = r.packed()
    present = r.take((n + 7) // 8)
    present_after = r.take((n + 7) // 8) if kind in ("update_rows", "partial_update_rows") else present
    while r.left() > 0:
        if kind == "partial_update_rows":
            before, why = image(r, columns, present)
            partial = r.packed()
            after, more = _partial_image(r, columns, present_after, partial)
            yield before, after, why | more
            continue
        first, why = image(r, columns, present)
        if kind == "update_rows":
            second, more = image(r, columns, present_after)
            yield first, second, why | more
        elif kind == "write_rows":
            yield None, first, why
        else:
            yield first, None, why


def _partial_image(r: Reader, columns: list[dict], present: bytes, options: int) -> tuple[dict, dict]:
    """An after image whose JSON columns may be differences: lists of op, path, value."""
    from millrace.functions.rowbytes import json_value, value

    documents = [k for k, c in enumerate(columns) if c["type"] == 245]
    partial = r.take((len(documents) + 7) // 8) if options & 1 else b"\0" * (len(documents) // 8 + 1)
    held = [k for k in range(len(columns)) if bit_at(present, k)]
    nulls = r.take((len(held) + 7) // 8)
    values: dict = {}
    reasons: dict[str, str] = {}
    for at, k in enumerate(held):
        name = columns[k].get("name") or f"UNKNOWN_COL{k}"
        if bit_at(nulls, at):
            values[name], reasons[name] = None, "null"
        elif k in documents and bit_at(partial, documents.index(k)):
            own, diffs = Reader(r.take(r.uint(4))), []
            while own.left():
                op = ("replace", "insert", "remove")[own.uint(1)]
                path = own.text(own.packed())
                diffs.append({"op": op, "path": path} | ({} if op == "remove" else {"value": json_value(own.take(own.packed()))}))
            values[name] = diffs or None
            if not diffs:
                reasons[name] = "same with before values"
        else:
            values[name], why = value(r, columns[k])
            if why:
                reasons[name] = why
    return values, reasons


_OPS = {"write_rows": "insert", "update_rows": "update", "delete_rows": "delete", "partial_update_rows": "update"}


def _known(maps: dict[bytes, tuple], raw: bytes) -> tuple[str, str, list[dict], list[str]]:
    """db, tab, columns and key of a table map, of which the last ones are held."""
    known = maps.get(raw)
    if known is None:
        if len(maps) > 1000:
            maps.clear()
        m = table_map(raw)
        keys = [c.get("name") or f"UNKNOWN_COL{k}" for k, c in enumerate(m["columns"]) if c.get("primary")]
        known = maps[raw] = m["db"], m["tab"], m["columns"], keys
    return known


def _changes(name: str, pos: int, ts: int, code: int, kind: str, body: bytes, known: tuple, last_only: bool = False) -> Iterator[tuple]:
    """Rows of one row event, in the order of _ROW."""
    db, tab, columns, keys = known
    extra = extra_data(kind, body) if code >= 30 and body[8:10] != b"\x02\0" else None
    said = json.dumps(extra) if extra else None
    for k, (before, after, why) in enumerate(decode_rows(kind, code, body, columns)):
        first = None if not before or (last_only and after) else as_json(before)
        yield name, pos, k, ts, db, tab, _OPS[kind], keys, first, as_json(after) if after else None, json.dumps(why) if why else None, said


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def changes(of: DataFrame) -> DataFrame:
    """One row per row change of mapped row events: images as JSON text, the key's columns, reasons of nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[bytes, tuple] = {}
        for b in batches:
            out = [row for *e, m in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in _changes(*e, _known(maps, m))]
            if out:
                yield _batch(out, _ROW)

    return of.select("src_file", "pos", "ts", "type", "kind", "body", "map").mapInArrow(run, ROW_TYPES)


_TRX = pa.schema([*_ROW, *(pa.field(n, pa.int64() if n != "server_uuid" else pa.string()) for n in ("server_uuid", "trx_id", "last_committed", "sequence_number", "gtid_pos"))])


def _in_place(content: bytes, name: str) -> Iterator[tuple]:
    """Row events of one file in its order: pos, ts, type, kind, body, the table map that holds (see mapped), the transaction (see oplog)."""
    maps: dict[bytes, bytes] = {}
    trx: tuple = (None,) * 5
    for _, at, ts, code, kind, _, _, _, _, body, _ in _split(content, name, checked=False):
        if kind == "table_map":
            maps[body[:6]] = body
        elif kind in ROWS:
            if body[:6] in maps:
                yield at, ts, code, kind, body, maps[body[:6]], trx
        elif kind == "gtid":
            said = details(kind, body)
            numbers = (said.get(n) for n in ("trx_id", "last_committed", "sequence_number"))
            trx = said["server_uuid"], *(n if n is None or n < 1 << 63 else None for n in numbers), at
        elif kind == "rotate" and ts > 0:
            maps.clear()


def oplog_of(files: DataFrame, last_only: bool = False) -> DataFrame:
    """What oplog(events(files)) is, in the one pass in which a task splits its files: what holds at a row's place was met before it in the file, so
    no order is made again and nothing is shuffled or kept. last_only: before is null where there is an after image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[bytes, tuple] = {}
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows: list[tuple] = []
                size, name = 0, path.rsplit("/", 1)[-1]
                for pos, ts, code, kind, body, m, trx in _in_place(content.as_py(), name):
                    for row in _changes(name, pos, ts, code, kind, body, _known(maps, m), last_only):
                        rows.append(row + trx)
                        size += len(row[8] or "") + len(row[9] or "")
                        if len(rows) == _BATCH_ROWS or size >= _BATCH_BYTES:
                            yield _batch(rows, _TRX)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, _TRX)

    return files.select("path", "content").mapInArrow(run, f"{ROW_TYPES}, server_uuid string, trx_id long, last_committed long, sequence_number long, gtid_pos long")


def oplog(of: DataFrame) -> DataFrame:
    """Row changes of events, wherever these come from, with the transaction they stand in: server_uuid, trx_id, last_committed, sequence_number, and gtid_pos,
    where it begins; of files see oplog_of. Files are split once, into a table that the passes over positions and bodies read."""
    of = kept(of.where(F.col("kind").isin("gtid", "table_map", "rotate", *ROWS)), "events")
    said = with_details(of.where(F.col("kind") == "gtid"))
    fields = F.from_json("details", "server_uuid string, trx_id long, last_committed long, sequence_number long")
    marks = said.select("src_file", "pos", fields.withField("gtid_pos", F.col("pos")).alias("g"))
    places = of.where(F.col("kind").isin(*ROWS)).select("src_file", "pos").unionByName(marks, allowMissingColumns=True)
    last = F.when(F.col("g").isNotNull(), F.struct("pos", "g"))
    known = with_running(places, "pos", last, "_last", ["src_file"], "max").where("g is null").select("src_file", "pos", "_last.g.*")
    return changes(mapped(of)).join(known, ["src_file", "pos"])


def in_one_order(rows: DataFrame) -> DataFrame:
    """Row changes of several files with pos and gtid_pos as numbers that grow along all of them: the number that ends the
    file's name (an ending aside; a name without one is file 0), then the byte. Rows of one event take the bytes behind its beginning, of which each row has one at least."""
    file = F.coalesce(F.regexp_extract("src_file", r"([0-9]{1,7})(?:\.[A-Za-z]+)?$", 1).try_cast("long"), F.lit(0)) * (1 << 40)
    return rows.withColumn("gtid_pos", file + F.col("gtid_pos")).withColumn("pos", file + F.col("pos") + F.col("row_idx"))
