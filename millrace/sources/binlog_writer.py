"""Writes binary logs: what the reader is tried with where no server is at hand."""

from __future__ import annotations

import struct
import uuid
import zlib

from millrace.sources.binlog import _HEADER, MAGIC


def packed(n: int) -> bytes:
    if n < 251:
        return bytes([n])
    return b"\xfc" + n.to_bytes(2, "little") if n < 1 << 16 else b"\xfd" + n.to_bytes(3, "little") if n < 1 << 24 else b"\xfe" + n.to_bytes(8, "little")


def named(s: str) -> bytes:
    raw = s.encode()
    return packed(len(raw)) + raw


class Log:
    """A file in memory: add events, then take bytes."""

    def __init__(self, ts: int = 0):
        self.out = bytearray(MAGIC)
        self.add(15, struct.pack("<H50sI", 4, b"8.0.36", ts) + b"\x13" + bytes(41) + b"\x01", ts)

    def add(self, kind: int, body: bytes, ts: int) -> int:
        at, size = len(self.out), 19 + len(body) + 4
        head = _HEADER.pack(ts, kind, 1, size, at + size, 0) + body
        self.out += head + zlib.crc32(head).to_bytes(4, "little")
        return at

    def gtid(self, server: str, number: int, last_committed: int, sequence: int, ts: int) -> int:
        return self.add(33, b"\x01" + uuid.UUID(server).bytes + struct.pack("<qBqq", number, 2, last_committed, sequence), ts)

    def query(self, schema: str, sql: str, ts: int) -> int:
        raw = schema.encode()
        return self.add(2, struct.pack("<IIBHH", 1, 0, len(raw), 0, 0) + raw + b"\0" + sql.encode(), ts)

    def table_map(self, table_id: int, db: str, tab: str, types: bytes, meta: bytes, names: list[str], primary: list[int], extra: bytes, ts: int) -> int:
        return self.add(19, self.map_body(table_id, db, tab, types, meta, names, primary, extra), ts)

    @staticmethod
    def map_body(table_id: int, db: str, tab: str, types: bytes, meta: bytes, names: list[str], primary: list[int], extra: bytes) -> bytes:
        n = len(types)
        body = table_id.to_bytes(6, "little") + b"\x01\x00" + bytes([len(db)]) + db.encode() + b"\0" + bytes([len(tab)]) + tab.encode() + b"\0"
        body += packed(n) + types + packed(len(meta)) + meta + b"\xff" * ((n + 7) // 8)
        columns, keys = b"".join(map(named, names)), b"".join(map(packed, primary))
        return body + b"\x04" + packed(len(columns)) + columns + b"\x08" + packed(len(keys)) + keys + extra

    def rows(self, kind: int, table_id: int, n: int, images: bytes, ts: int) -> int:
        full = ((1 << n) - 1).to_bytes((n + 7) // 8, "little")
        body = table_id.to_bytes(6, "little") + b"\x01\x00" + b"\x02\x00" + packed(n) + full + (full if kind == 31 else b"") + images
        return self.add(kind, body, ts)

    def xid(self, n: int, ts: int) -> int:
        return self.add(16, n.to_bytes(8, "little"), ts)

    def bytes(self) -> bytes:
        return bytes(self.out)


def change_image(pk: int, value: float | None, props: str | None) -> bytes:
    """A row of (pk bigint, value double, props varchar(2000))."""
    nulls = (value is None) << 1 | (props is None) << 2
    out = bytes([nulls]) + pk.to_bytes(8, "little", signed=True)
    if value is not None:
        out += struct.pack("<d", value)
    if props is not None:
        raw = props.encode()
        out += len(raw).to_bytes(2, "little") + raw
    return out


def write_changes(rows: list[dict]) -> bytes:
    """The log of changes (trx_no, server_uuid, trx_id, last_committed, db, tab, op, pk, value, props, ts), in order."""
    log, open_trx, maps = Log(), None, {}
    for r in rows:
        if r["trx_no"] != open_trx:
            if open_trx is not None:
                log.xid(open_trx, r["ts"])
            open_trx = r["trx_no"]
            log.gtid(r["server_uuid"], r["trx_id"], r["last_committed"], r["trx_no"] + 1, r["ts"])
            log.query(r["db"], "BEGIN", r["ts"])
        known = maps.get((r["db"], r["tab"]))
        if known is None:
            table_id = 100 + len(maps)
            known = maps[r["db"], r["tab"]] = table_id, log.map_body(table_id, r["db"], r["tab"], bytes([8, 5, 15]), bytes([8]) + (2000).to_bytes(2, "little"), ["pk", "value", "props"], [0], b"")
        table_id, body = known
        log.add(19, body, r["ts"])
        one = change_image(r["pk"], r["value"], r["props"])
        log.rows({"insert": 30, "update": 31, "delete": 32}[r["op"]], table_id, 3, one * 2 if r["op"] == "update" else one, r["ts"])
    if open_trx is not None:
        log.xid(open_trx, rows[-1]["ts"])
    return log.bytes()
