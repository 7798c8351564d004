"""Value functions of the log's column types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes of the log, and the largest distance a batch size moves.
NAMES = {
    0: "decimal", 1: "tiny", 2: "short", 3: "long", 4: "float", 5: "double", 6: "null", 7: "timestamp", 8: "longlong", 9: "int24",
    10: "date", 11: "time", 12: "datetime", 13: "year", 14: "newdate", 15: "varchar", 16: "bit", 17: "timestamp2", 18: "datetime2",
    19: "time2", 245: "json", 246: "newdecimal", 247: "enum", 248: "set", 249: "tiny_blob", 250: "medium_blob", 251: "long_blob",
    252: "blob", 253: "var_string", 254: "string", 255: "geometry",
}


def set_labels(mask: Column, labels: list[str]) -> Column:
    """Labels of a SET mask in the order of their definition."""
    held = [F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(label)) for k, label in enumerate(labels)]
    return F.array_compact(F.array(*held))


def set_text(mask: Column, labels: list[str]) -> Column:
    return F.array_join(set_labels(mask, labels), ",")


def enum_label(index: Column, labels: list[str]) -> Column:
    """Label of an ENUM index; 0 is the empty text, an index without a label null."""
    return F.get(F.array(F.lit(""), *map(F.lit, labels)), index.cast("int"))


def bit_text(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value), width, "0")


def bit_bytes(text: Column) -> Column:
    """A bit text as big-endian bytes; all zeros are one zero byte's width of the text."""
    return F.unhex(F.lpad(F.conv(text, 2, 16), F.ceil(F.length(text) / 8).cast("int") * 2, F.lit("0")))


def bits_set(value: Column) -> Column:
    return F.bit_count(value)


def bit_at(value: Column, k: Column) -> Column:
    return F.getbit(value, k)


def fraction(raw: Column, fsp: int) -> Column:
    """Stored fractional seconds (1, 2 or 3 bytes for up to 2, 4 or 6 digits) in microseconds."""
    stored = 10 ** (6 - 2 * ((fsp + 1) // 2))
    return (raw * stored).cast("long")


def uuid_text(sid: Column) -> Column:
    """16 bytes as 8-4-4-4-12 hexadecimal digits."""
    h = F.lower(F.hex(sid))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def split_clean(text: Column) -> Column:
    """Comma-separated parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def middle(values: Column) -> Column:
    """Median of an array of integers; of an even number, the mean of the middle two, rounded down."""
    s = F.array_sort(values)
    n = F.size(values)
    both = F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.floor(both / 2)).cast("long")


def dsn_part(text: Column, part: str) -> Column:
    """user, password, host or port of user/password@host:port."""
    return F.regexp_extract(text, r"^([^/]*)/(.*)@([^:@]*):([0-9]+)$", ("user", "password", "host", "port").index(part) + 1)


def cell_text(code: Column, value: Column) -> Column:
    """A cell as SQL text, by type code: times from epochs, quoted labels, quoted texts, numbers as they are."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return (
        F.when(value.isNull(), "NULL")
        .when(code.isin(7, 17), F.concat(F.lit("FROM_UNIXTIME("), value, F.lit(")")))
        .when(code.isin(1, 2, 3, 4, 5, 8, 9, 13, 246), value)
        .otherwise(quoted)
    )


def empty_not_null(value: Column, is_null: Column, code: Column) -> Column:
    """A blob that travelled as nothing is empty, unless it was null."""
    return F.when((code == 252) & ~is_null, F.coalesce(value, F.lit(""))).otherwise(value)


def fetch_count(base: Column, filled: Column, latency_ms: Column, max_ms: int, faster: Column) -> tuple[Column, Column]:
    """The next batch size by latency: (base, fetch). Too slow: divided by how much; as fast as
    before (faster): 100 more, then 10 less; fetched: between 10 and what is there, in tens."""
    first = F.greatest(F.floor(filled / 100 / 10) * 10, F.lit(10))
    slow = F.floor(base / (latency_ms / max_ms))
    new = F.when(base.isNull(), first).otherwise(F.when(latency_ms > max_ms, slow).otherwise(base + F.when(faster, 100).otherwise(0)) - 10)
    new = F.greatest(new, F.lit(10)).cast("long")
    fetch = F.floor(F.least(F.greatest(new, F.lit(10)), F.greatest(filled, F.lit(10))) / 10) * 10
    return new, fetch.cast("long")


def parameter(code: Column, value: Column, labels: Column) -> Column:
    """A cell's text as a statement's parameter: BIT texts as hexadecimal bytes, SETs (labels) comma-joined,
    anything else as it is; null stays null."""
    bits = F.hex(bit_bytes(value))
    return F.when(code == 16, bits).when(code == 248, F.array_join(labels, ",")).otherwise(value)
