"""Versions of tables' columns, from CREATE TABLE and ALTER TABLE, and rows carried over to the last one.

Row images hold values by place. A column keeps its id under every name and place that statements give it, so an image of
an older version is read by the ids of that version and written by those of the last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.statements import NAME, TABLE, bare, list_items, unquoted
from millrace.plans.ordered import with_running

_NO_COLUMN = r"(?!(?:primary|unique|index|key|constraint|fulltext|spatial|foreign|check|partition)\b)"
_VALUE = r"('(?:[^'\\]|\\.|'')*'|[^\s,]+)"
#: Part of an ALTER TABLE: what it does, and a pattern whose groups are the column, its new name and what follows.
ACTIONS = (
    ("add", rf"(?is)^add\s+(?:column\s+)?{_NO_COLUMN}({NAME})()\s+(.*)$"),
    ("drop", rf"(?is)^drop\s+(?:column\s+)?{_NO_COLUMN}({NAME})()()$"),
    ("rename", rf"(?is)^rename\s+column\s+({NAME})\s+to\s+({NAME})()$"),
    ("change", rf"(?is)^change\s+(?:column\s+)?({NAME})\s+({NAME})\s+(.*)$"),
    ("modify", rf"(?is)^modify\s+(?:column\s+)?({NAME})()\s+(.*)$"),
)
_CREATE = rf"(?is)^create\s+(?:temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?{TABLE}\s*\((.*)\)[^)]*$"
_VERSION = "db string, tab string, version long, columns array<struct<id:string,name:string,initial:string>>"


def _initial(rest: Column) -> Column:
    """A column's value in rows that were there before it: its default without quotes, null if it has none."""
    text = F.regexp_extract(rest, rf"(?is)\bdefault\s+{_VALUE}", 1)
    quoted = text.startswith("'")
    plain = F.regexp_replace(F.regexp_replace(F.expr("substring(_text, 2, length(_text) - 2)"), "''", "'"), r"\\(.)", "$1")
    return F.when(text == "", None).when(quoted, plain).when(F.upper(text) != "NULL", text), text


def column_changes(named: DataFrame) -> DataFrame:
    """pos, part, db, tab, action, name, new_name, initial, place: what statements do to columns.

    named: statements (pos, query, kind) with the table that each is about (db, tab). CREATE TABLE gives one row a column, action `create`; ALTER
    TABLE one for each of its parts that adds, drops, renames, changes or modifies a column. Other parts, such as indexes, and
    other statements give none. place: `first`, the column that it stands after, or null. A list of columns in parentheses
    behind ADD is not read.
    """
    text = bare(F.col("query"))
    create = F.col("kind") == "ddl_create_table"
    body = F.when(create, F.regexp_extract(text, _CREATE, 1)).otherwise(F.regexp_replace(text, rf"(?is)^alter\s+table\s+{TABLE}\s*", ""))
    parts = named.where("kind in ('ddl_create_table', 'ddl_alter_table')").select("pos", "db", "tab", create.alias("_create"), F.posexplode(list_items(body)).alias("part", "_one"))
    action, groups = F.lit(None).cast("string"), [F.lit(None).cast("string")] * 3
    for name, pattern in reversed((*ACTIONS, ("create", rf"(?is)^{_NO_COLUMN}({NAME})()\s+(.*)$"))):
        hit = F.col("_one").rlike(pattern) & (F.col("_create") if name == "create" else ~F.col("_create"))
        action = F.when(hit, name).otherwise(action)
        groups = [F.when(hit, F.regexp_extract("_one", pattern, k + 1)).otherwise(g) for k, g in enumerate(groups)]
    read = parts.select("pos", "part", "db", "tab", action.alias("action"), unquoted(groups[0]).alias("name"), unquoted(groups[1]).alias("new_name"), groups[2].alias("_rest")).where("action is not null")
    initial, text = _initial(F.col("_rest"))
    after = unquoted(F.regexp_extract("_rest", rf"(?is)\bafter\s+({NAME})\s*$", 1))
    place = F.when(F.col("_rest").rlike(r"(?is)\bfirst\s*$"), "first").when(after != "", F.concat(F.lit("after "), after))
    return read.withColumn("_text", text).withColumn("initial", initial).withColumn("place", F.when(F.col("action") != "create", place)).drop("_rest", "_text")


def _replayed(changes: pd.DataFrame) -> pd.DataFrame:
    """The versions of one table: its statements, a few in a table's life, in order."""
    columns: list[dict] = []
    out = []
    for pos, group in changes.sort_values(["pos", "part"]).groupby("pos", sort=True):
        if (group["action"] == "create").any():
            columns = []
        for c in group.itertuples():
            at = next((k for k, one in enumerate(columns) if one["name"].lower() == c.name.lower()), None)
            if c.action in ("add", "create"):
                own, at = {"id": f"{c.pos}:{c.part}", "name": c.name, "initial": c.initial}, len(columns)
            elif at is None:
                continue
            else:
                own = columns.pop(at)
                if c.action == "drop":
                    continue
                own = own | {"name": c.new_name or own["name"]}
            if c.place == "first":
                at = 0
            elif c.place:
                at = next((k + 1 for k, one in enumerate(columns) if one["name"].lower() == c.place[6:].lower()), at)
            columns.insert(at, own)
        out.append((pos, [dict(c) for c in columns]))
    return pd.DataFrame({"db": changes["db"].iloc[0], "tab": changes["tab"].iloc[0], "version": [v for v, _ in out], "columns": [c for _, c in out]})


def versions(changes: DataFrame) -> DataFrame:
    """db, tab, version, columns (id, name, initial, in order): a table's columns from behind position `version` on."""
    text = changes.withColumns({c: F.col(c) for c in ("initial", "place")}).select("pos", "part", "db", "tab", "action", "name", "new_name", "initial", "place")
    return text.groupBy("db", "tab").applyInPandas(lambda pdf: _replayed(pdf.astype(object).where(pdf.notna(), None)), _VERSION)


def projected(rows: DataFrame, history: DataFrame, image: str = "image") -> DataFrame:
    """rows (pos, db, tab, image: array of values by place) with image as a map from the column names of their table's last version.

    history: versions(). A row's own version is the last one before its position; what was dropped since is left out, what was added
    since has its initial value. Rows of tables without a version before them are left out. An image shorter than its version ends in nulls.

    The version is carried along the order, so a table with a third of all rows is no single task's; versions then meet
    rows by (table, version), of which there are as many as statements.
    """
    marked = rows.withColumn("_k", 2 * F.col("pos")).unionByName(history.select((2 * F.col("version") + 1).alias("_k"), "db", "tab", F.col("version").alias("_own")), allowMissingColumns=True)
    seen = with_running(marked, "_k", F.col("_own"), "version", ["db", "tab"], "max").where("_own is null").drop("_k", "_own")
    last = history.groupBy("db", "tab").agg(F.max_by("columns", "version").alias("_last"))
    met = seen.join(history, ["db", "tab", "version"]).join(last, ["db", "tab"])
    ids = F.transform("columns", lambda c: c["id"])
    value = lambda c: F.when(F.array_contains(ids, c["id"]), F.get(F.col(image), (F.array_position(ids, c["id"]) - 1).cast("int"))).otherwise(c["initial"])
    return met.withColumn(image, F.map_from_arrays(F.transform("_last", lambda c: c["name"]), F.transform("_last", value))).select(*rows.columns)
