"""Textual logs: the dump that log tools print of a binary log.

Spark splits the text at its own position lines, so a record is one event: position, header line, body.
Everything else is regular expressions over records.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.values import set_text
from millrace.plans.ordered import with_previous
from millrace.plans.shared import kept

_HEAD = r"^(?:# at )?(\d+)\n#(\d{6} +\d{1,2}:\d{2}:\d{2}) server id (\d+) +end_log_pos (\d+)(?: CRC32 0x[0-9a-f]+)?\s+([A-Za-z_]+)"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of files: src_file, record. The text before the first event is no record."""
    lines = spark.read.option("lineSep", "\n# at ").text(path)
    return lines.select(F.col("_metadata.file_name").alias("src_file"), F.col("value").alias("record"))


def _field(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("record", pattern, group), F.lit(""))


# A column of a table map: the first one behind "Columns(", each other one on its own line under it.
_COLUMN = r"(?m)^#(?: Columns\(| {9})`((?:[^`\n]|``)+)`\s*((?:ENUM|SET)\((?:[^')\n]*+'[^']*+')*+[^')\n]*+\)|\w+(?:\([^)\n]*\))?)?"


def _columns() -> Column:
    """The record's columns in order: name, type (the labels of an ENUM or SET with it)."""
    names, types = (F.regexp_extract_all("record", F.lit(_COLUMN), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, types, lambda n, t: F.struct(F.replace(n, F.lit("``"), F.lit("`")).alias("name"), t.alias("type")))


def parse(records: DataFrame) -> DataFrame:
    """src_file, at, ts, server_id, end_log_pos, event and what the event's own lines say.

    Each field is looked for in the events that have it, so that long bodies of rows are read for their rows alone.
    """
    number = lambda c: c.cast("long")
    # The head is matched once: a row without one has nothing to explode, and the head's fields are cut out of what was found.
    # Its last word is the event, which filters ask for several times: it is cut out where the head is found.
    word = lambda head: reduce(lambda rest, space: F.substring_index(rest, space, -1), " \t\n\x0b\f\r", head)
    found = F.transform(F.regexp_extract_all("record", F.lit(_HEAD), F.lit(0)), lambda h: F.struct(h.alias("_head"), word(h).alias("event")))
    heads = records.select("src_file", "record", F.inline(found))
    at = F.substring_index(F.substring_index("_head", "\n", 1), " ", -1)
    ts = F.substring_index(F.substr("_head", F.instr("_head", "\n") + 2), " server id ", 1)
    server, rest = F.substring_index(F.substring_index("_head", " server id ", -1), " ", 1), F.substring_index("_head", " end_log_pos ", -1)
    heads = heads.select(
        "src_file", number(at).alias("at"), F.to_timestamp(F.regexp_replace(ts, " +", " "), "yyMMdd H:mm:ss").alias("ts"), number(server).alias("server_id"),
        number(F.regexp_extract(rest, r"^\d+", 0)).alias("end_log_pos"), "event", "record",
    )
    event = F.col("event")
    rows, of_map, of_gtid = event.endswith("_rows"), event == "Table_map", event.endswith("GTID")
    return heads.select(
        "src_file", "at", "ts", "server_id", "end_log_pos", "event",
        F.when(of_gtid, number(_field(r"last_committed=(\d+)"))).alias("last_committed"), F.when(of_gtid, number(_field(r"sequence_number=(\d+)"))).alias("sequence_number"),
        F.when(of_gtid, _field(r"GTID_NEXT= ?'([0-9a-f-]{36}:\d+)'")).alias("gtid"),
        F.when(of_map, _field(r"Table_map: `([^`]+)`\.`[^`]+` mapped to number")).alias("db"), F.when(of_map, _field(r"Table_map: `[^`]+`\.`([^`]+)` mapped to number")).alias("tab"),
        number(F.when(of_map, _field(r"mapped to number (\d+)")).when(rows, _field(r"_rows: table id (\d+)"))).alias("table_id"),
        F.when(of_map, _columns()).alias("columns"), F.when(event == "Xid", number(_field(r"Xid = (\d+)"))).alias("xid"),
        (~rows & F.col("record").rlike(r"(?m)^COMMIT")).alias("is_commit"), (~rows & F.col("record").rlike(r"(?m)^ROLLBACK")).alias("is_rollback"),
        F.when(rows, F.regexp_extract_all("record", F.lit(r"(?m)^### (.*)$"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("row_lines"), "record",
    )


def misplaced(parsed: DataFrame) -> DataFrame:
    """Records that do not begin where the one before ended: a text that only looks like a position line."""
    seen = with_previous(parsed.select("src_file", "at", "end_log_pos"), "at", F.col("end_log_pos"), "expected", ["src_file"])
    return seen.where("expected is not null and at <> expected").select("src_file", "at", "expected")


def statistics(parsed: DataFrame) -> DataFrame:
    """One row: how many events of each kind, and the last transaction id, time, position and file."""
    n = lambda what, name: F.count_if(what).alias(name)
    e, last = F.col("event"), F.struct("src_file", "at")
    return parsed.agg(
        n(e == "Write_rows", "write_rows"), n(e == "Update_rows", "update_rows"), n(e == "Delete_rows", "delete_rows"), n(e == "Table_map", "table_maps"),
        n(F.col("is_commit"), "commits"), n(F.col("is_rollback"), "rollbacks"), F.max_by("gtid", F.when(F.col("gtid").isNotNull(), last)).alias("last_gtid"),
        F.max_by("ts", last).alias("last_ts"), F.max("at").alias("last_at"), F.max("src_file").alias("last_file"),
    )


def table_statistics(parsed: DataFrame) -> DataFrame:
    """db, tab, writes, updates, deletes: row events by table id, named by the first map of the id."""
    rows = parsed.where(F.col("event").isin("Write_rows", "Update_rows", "Delete_rows")).groupBy("src_file", "table_id").agg(*(F.count_if(F.col("event") == k).alias(a) for k, a in (("Write_rows", "writes"), ("Update_rows", "updates"), ("Delete_rows", "deletes"))))
    maps = parsed.where("event = 'Table_map'").groupBy("src_file", "table_id").agg(F.min_by(F.struct("db", "tab"), "at").alias("m"))
    named = rows.join(maps, ["src_file", "table_id"])
    return named.groupBy("m.db", "m.tab").agg(*(F.sum(c).alias(c) for c in ("writes", "updates", "deletes")))


# A stretch of the log in bytes: what it holds of a file is put in order by one window.
WIDTH = 1 << 20


def _meeting(parsed: DataFrame, with_trx: bool = False) -> DataFrame:
    """Row events with the columns of the last table map of their table id before them in the file, and with the last transaction id
    (trx: gtid_pos, gtid, last_committed); null without one.

    A file is cut into stretches. Inside one, rows meet what stands before them in a window, bodies and all, so these are shuffled once and joined to nothing large;
    what the stretches before leave behind is one row for each of their table ids."""
    event, has_trx = F.col("event"), F.col("gtid").isNotNull()
    rows, of_map = event.endswith("_rows"), event == "Table_map"
    trx = F.when(has_trx, F.struct(F.col("at").alias("gtid_pos"), "gtid", "last_committed"))
    of = parsed.where((rows | of_map | has_trx) if with_trx else (rows | of_map))
    of = of.withColumns({"_stretch": F.floor(F.col("at") / WIDTH), "_id": F.coalesce("table_id", F.lit(-1)), "trx": trx})
    by, whole = ["src_file", "_stretch", "_id"], ["src_file", "_stretch"]
    before = lambda *keys: Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)

    own = F.when(of_map, F.struct("columns"))
    if with_trx:
        # Columns are read out of the last map of a stretch alone.
        ends = of.select(*by, "at", F.when(of_map, F.col("record")).alias("record"), "trx").groupBy(*by)
        ends = kept(ends.agg(F.max_by("record", F.when(F.col("record").isNotNull(), F.col("at"))).alias("record"), F.max("trx").alias("trx")), "ends")
        maps = ends.select(*by, F.when(F.col("record").isNotNull(), F.struct(_columns().alias("columns"))).alias("_end"))
        last = ends.groupBy(*whole).agg(F.max("trx").alias("trx"))
        last = last.select(*whole, F.last("trx", ignorenulls=True).over(earlier("src_file")).alias("_trx_end"))
        of = of.withColumn("trx", F.last("trx", ignorenulls=True).over(before(*whole)))
        met = of.withColumn("_map", F.last(own, ignorenulls=True).over(before(*by)))
    else:
        # What a stretch leaves behind is read behind the same window: texts are parsed and shuffled once for both.
        met = of.withColumn("_map", F.last(own, ignorenulls=True).over(before(*by))).drop("trx")
        maps = met.groupBy(*by).agg(F.max_by("_map", "at").alias("_end"), F.max(rows & (F.size("row_lines") > 0)).alias("_asks"))
    maps = maps.withColumn("_end", F.last("_end", ignorenulls=True).over(earlier("src_file", "_id")))
    if not with_trx:
        maps = maps.where("_asks").drop("_asks")  # stretches without rows are asked by none
    met = met.where(rows).join(maps, by, "left")
    met = met.withColumn("columns", F.coalesce("_map", "_end")["columns"])
    if with_trx:
        met = met.join(last, whole, "left").withColumn("trx", F.coalesce("trx", "_trx_end")).drop("_trx_end")
    return met.drop("_stretch", "_id", "_map", "_end")


def named(parsed: DataFrame) -> DataFrame:
    """Row events with the columns of the last table map of their table id before them in the file; null without one."""
    return _meeting(parsed)


def _cell(value: Column, type_: Column) -> Column:
    """A cell's text as SQL: an index of an ENUM and the bits of a SET as labels, the seconds of a TIMESTAMP as a time."""
    labels = type_labels(type_)
    quoted = lambda text: F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    number = value.rlike(r"^[0-9]{1,9}$")
    index = F.when(number, value).cast("int")
    bits = F.lpad(F.regexp_extract(value, r"^b'([01]+)'$", 1), 64, "0")
    held = F.array_join(F.filter(labels, lambda x, k: F.substr(bits, F.lit(64) - k, F.lit(1)) == "1"), ",")
    return (
        F.when(type_.startswith("ENUM(") & number, F.coalesce(quoted(F.when(index == 0, "").otherwise(F.get(labels, index - 1))), value))
        .when(type_.startswith("SET(") & value.rlike(r"^b'[01]+'$"), quoted(held))
        .when(type_.startswith("TIMESTAMP") & value.rlike(r"^[0-9.]+$"), F.concat(F.lit("FROM_UNIXTIME("), value, F.lit(")")))
        .otherwise(value)
    )


def _images(some: DataFrame, *more: str) -> DataFrame:
    """Row changes of ### blocks of row events with their columns: src_file, at, ts, more, part, op, target, before, after: arrays of name, v (SQL text)."""
    verbs = ("INSERT INTO ", "UPDATE ", "DELETE FROM ")
    begins = lambda x: reduce(or_, (x.startswith(v) for v in verbs))
    several = reduce(or_, (F.contains("_text", F.lit(f"\n{v}")) for v in verbs))
    # Most events have one block: a pattern is looked for where there are more.
    blocks = F.when(several, F.split("_text", rf"\n(?=(?:{'|'.join(verbs)}))")).otherwise(F.array("_text"))
    texts = some.where(F.size("row_lines") > 0).select("src_file", "at", "ts", *more, "columns", F.array_join("row_lines", "\n").alias("_text"))
    rows = texts.select("src_file", "at", "ts", *more, "columns", F.posexplode(F.filter(blocks, begins)).alias("part", "block"))
    set_at, where_at = F.instr("block", "\nSET\n"), F.instr("_old", "\nWHERE\n")
    last = lambda text, mark: F.substring_index(text, mark, -1)
    rows = rows.withColumn("_set", set_at).select("*", F.when(F.col("_set") > 0, F.left("block", F.col("_set") - 1)).otherwise(F.col("block")).alias("_old"), F.when(F.col("_set") > 0, last(F.substr("block", F.col("_set")), "\nSET\n")).otherwise("").alias("_new"))
    where = F.when(where_at > 0, last(F.substr("_old", where_at), "\nWHERE\n")).otherwise("")

    def cells(of: Column) -> Column:
        """Lines of cells: their number is looked for once, a comment behind the value only where there may be one."""
        lines = F.filter(F.split(of, "\n"), lambda x: x.rlike(r"^\s*@\d+="))
        number = lambda x: F.substring_index(F.substring_index(x, "=", 1), "@", -1)
        value = lambda v: F.when(v.endswith("*/"), F.regexp_replace(v, r" /\*.*\*/$", "")).otherwise(v)
        told = F.transform(lines, lambda x: F.struct(number(x).alias("k"), F.get("columns", number(x).cast("int") - 1).alias("c"), value(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
        typed = lambda t: t.startswith("ENUM(") | t.startswith("SET(") | t.startswith("TIMESTAMP")
        return F.transform(told, lambda x: F.struct(F.coalesce(x["c"]["name"], F.concat(F.lit("@"), x["k"])).alias("name"), F.when(typed(x["c"]["type"]), _cell(x["v"], x["c"]["type"])).otherwise(x["v"]).alias("v")))

    op = F.lower(F.substring_index("block", " ", 1))
    target = F.regexp_extract("block", r"^(?:INSERT INTO|UPDATE|DELETE FROM) (\S+)", 1)
    return rows.select("src_file", "at", "ts", *more, F.col("part").cast("long").alias("part"), op.alias("op"), target.alias("target"), cells(where).alias("before"), cells(F.col("_new")).alias("after"))


def statements(parsed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row changes of ### blocks as statements: src_file, at, part, op, target, sql.

    columns: names by position; else those of the table map that holds (see named). A position without a
    name stands for itself. An update's WHERE is its before image. A cell that is null is compared with IS.
    """
    op, target = F.col("op"), F.col("target")
    name = lambda c: F.concat(F.lit("`"), F.replace(c["name"], F.lit("`"), F.lit("``")), F.lit("`"))
    match = lambda cs: F.array_join(F.transform(cs, lambda c: F.concat(name(c), F.when(c.v == "NULL", " IS ").otherwise(" = "), c.v)), " AND ")
    put = lambda cs: F.array_join(F.transform(cs, lambda c: F.concat(name(c), F.lit(" = "), c.v)), ", ")
    sql = (
        F.when(op == "insert", F.concat(F.lit("INSERT INTO "), target, F.lit(" SET "), put("after")))
        .when(op == "update", F.concat(F.lit("UPDATE "), target, F.lit(" SET "), put("after"), F.lit(" WHERE "), match("before")))
        .otherwise(F.concat(F.lit("DELETE FROM "), target, F.lit(" WHERE "), match("before")))
    )
    if columns is None:
        some = named(parsed)
    else:
        given = F.array(*(F.struct(F.lit(c).alias("name"), F.lit("").alias("type")) for c in columns))
        some = parsed.where(F.col("event").endswith("_rows")).withColumn("columns", given)
    return _images(some).select("src_file", "at", "part", "op", "target", sql.alias("sql"))


def _plain(v: Column) -> Column:
    """A cell's SQL text as its value: without quotes, escapes and FROM_UNIXTIME; null for NULL."""
    code = r"\\x([0-9a-f]{2})"
    inner = F.substr(v, F.lit(2), F.length(v) - 2)
    chars = F.transform(F.regexp_extract_all(v, F.lit(code), F.lit(1)), lambda h: F.char(F.conv(h, 16, 10).cast("long")))
    parts = F.split(F.replace(inner, F.lit("''"), F.lit("'")), code, -1)
    text = F.array_join(F.zip_with(parts, F.concat(chars, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(v == "NULL", None).when(v.startswith("'"), text).otherwise(F.regexp_replace(v, r"^FROM_UNIXTIME\((.*)\)$", "$1"))


def oplog(parsed: DataFrame, row: str) -> DataFrame:
    """Row changes with their values and the transaction they stand in: src_file, pos, row_idx, ts, server_uuid, trx_id, last_committed,
    gtid_pos, db, tab, op, before, after. row: the wanted columns, as a schema; what an image does not name, or what is of
    another type, is null. before and after are null where the change has no such image."""
    fields = StructType.fromDDL(row).fields
    rows = _images(_meeting(parsed, with_trx=True), "trx")

    def image(cells: str) -> Column:
        of = lambda f: F.get(F.filter(cells, lambda c: c["name"] == f.name), F.lit(0))["v"]
        return F.when(F.size(cells) > 0, F.struct(*(_plain(of(f)).try_cast(f.dataType).alias(f.name) for f in fields)))

    values = rows.select("src_file", "at", F.col("part").alias("row_idx"), "ts", "trx", "op", "target", image("before").alias("before"), image("after").alias("after"))
    part = lambda k: F.replace(F.regexp_extract("target", r"^`((?:[^`]|``)*)`\.`((?:[^`]|``)*)`$", k), F.lit("``"), F.lit("`"))
    uuid, n = F.substring_index("trx.gtid", ":", 1), F.substring_index("trx.gtid", ":", -1).cast("long")
    return values.select("src_file", F.col("at").alias("pos"), "row_idx", "ts", uuid.alias("server_uuid"), n.alias("trx_id"), "trx.last_committed", "trx.gtid_pos", part(1).alias("db"), part(2).alias("tab"), "op", "before", "after")


def type_labels(type_text: Column) -> Column:
    """Labels of an ENUM('a','b') or SET(...) type text; quotes may hold commas and doubled quotes."""
    return F.transform(F.regexp_extract_all(type_text, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))


def label_text(kind: str, index: Column, labels: list[str]) -> Column:
    """A quoted ENUM or SET cell."""
    from millrace.functions.values import enum_label

    return F.concat(F.lit("'"), enum_label(index, labels) if kind == "enum" else set_text(index, labels), F.lit("'"))


def write(ops: DataFrame, second: Column | None = None) -> DataFrame:
    """Records of an operation log: two a change (map and rows), their transaction's id before its first one. second: what the map calls the second column."""
    at, said = F.col("pos") * 1000, lambda c: F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null"))
    joined = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    head = lambda shift, size, what: joined(said(at + shift), "\n#", said("_time"), " server id 1  end_log_pos ", said(at + shift + size), " CRC32 0x00000000 \t", what)
    table_id = said(F.when(F.col("tab") == "users", 100).otherwise(200) + F.when(F.col("db") == "mysql", 1).when(F.col("db") == "audit", 2).otherwise(3))
    gtid = joined(head(0, 300, joined("GTID\tlast_committed=", said("last_committed"), "\tsequence_number=", said(F.col("trx_no") + 1))), "\nSET @@SESSION.GTID_NEXT= '", said("server_uuid"), ":", said("trx_id"), "'/*!*/;")
    columns = joined("\n# Columns(`id` BIGINT NOT NULL,\n#         `", "props" if second is None else said(second), "` VARCHAR(200) CHARSET utf8mb4)\n# Primary Key(id)")
    table = joined(head(300, 300, joined("Table_map: `", said("db"), "`.`", said("tab"), "` mapped to number ", table_id)), columns)
    event = F.when(F.col("op") == "insert", "Write_rows").when(F.col("op") == "update", "Update_rows").otherwise("Delete_rows")
    rows = head(600, 400, joined(event, ": table id ", table_id, " flags: STMT_END_F"))
    cell = joined("\n###   @1=", said("pk"), "\n###   @2='", said("props"), "'")
    verb = joined("\n### ", F.when(F.col("op") == "insert", "INSERT INTO").when(F.col("op") == "update", "UPDATE").otherwise("DELETE FROM"), " `", said("db"), "`.`", said("tab"), "`")
    body = joined(verb, F.when(F.col("op") != "insert", joined("\n### WHERE", cell)).otherwise(""), F.when(F.col("op") != "delete", joined("\n### SET", cell)).otherwise(""))
    first = F.when(F.col("pos") % 4 == 0, F.array(gtid)).otherwise(F.array().cast("array<string>"))
    timed = ops.withColumn("_time", F.date_format("ts", "yyMMdd HH:mm:ss"))
    return timed.select(F.lit("log.000001").alias("src_file"), F.explode(F.concat(first, F.array(table, joined(rows, body)))).alias("record"))
