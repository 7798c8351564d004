"""Folding changes into a table: what the rows are after all of them, per mode of apply.

A fold is one aggregation by key: the last change wins by max_by, which Spark sums in parts before the
shuffle, so a key with a third of all changes is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import with_running
from millrace.plans.shared import kept

KEY = ("db", "tab", "pk")
ROW = ("value", "props")


def with_base(ops: DataFrame, base: DataFrame) -> DataFrame:
    """The changes behind a table as it is: its rows stand as inserts before all of them."""
    row = base.select(*KEY, *ROW).withColumn("pos", F.lit(-1).cast("long")).withColumn("op", F.lit("insert"))
    return ops.select("pos", "op", *KEY, *ROW).unionByName(row.select("pos", "op", *KEY, *ROW))


def _last(where: Column | None = None) -> Column:
    at = F.col("pos") if where is None else F.when(where, F.col("pos"))
    return F.max_by(F.struct("op", *ROW), at)


def replace(ops: DataFrame) -> DataFrame:
    """Inserts and updates write the whole row: a key is there unless its last change is a delete."""
    last = ops.groupBy(*KEY).agg(_last().alias("last"))
    return last.where("last.op <> 'delete'").select(*KEY, *(f"last.{c}" for c in ROW))


def last_changes(ops: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """The last change of each key, deletes included. Folding these gives what folding all gives, so
    batches can be shortened apart and folded together later. by: the key's columns, and such as follow from them."""
    last = ops.groupBy(*by).agg(_last().alias("last"), F.max("pos").alias("pos"))
    return last.select("pos", "last.op", *by, *(f"last.{c}" for c in ROW))


def update_only(ops: DataFrame) -> DataFrame:
    """Updates change rows that are there and nothing else; inserts write the row."""
    born = F.max_by(F.col("op"), F.when(F.col("op") != "update", F.col("pos")))
    last = ops.groupBy(*KEY).agg(born.alias("born"), _last().alias("last"))
    return last.where("born = 'insert'").select(*KEY, *(f"last.{c}" for c in ROW))


def _lives(ops: DataFrame) -> DataFrame:
    """ops after their key's last delete, with the first insert that follows it."""
    dead = ops.groupBy(*KEY).agg(F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("pos"))), F.lit(-2)).alias("dead"))
    alive = ops.join(dead, [*KEY]).where("pos > dead")
    born = alive.where("op = 'insert'").groupBy(*KEY).agg(F.min("pos").alias("born"))
    return alive.join(born, [*KEY])


def insert_only(ops: DataFrame) -> DataFrame:
    """An insert of a key that is there changes nothing (its error is skipped); updates need the row."""
    last = _lives(ops).where("pos = born or (op = 'update' and pos > born)").groupBy(*KEY).agg(_last().alias("last"))
    return last.select(*KEY, *(f"last.{c}" for c in ROW))


def refused_inserts(ops: DataFrame) -> DataFrame:
    """Inserts of a key that was there already, in its last life: the duplicate key errors."""
    return _lives(ops).where("op = 'insert' and pos > born").select("pos", *KEY)


def split_moves(ops: DataFrame, strict: bool = True) -> DataFrame:
    """Updates that change the key (new_pk) as a delete of the old and an insert of the new one, in
    this order at one position. strict = False leaves the old row, as appliers that only replace do."""
    moved = F.col("new_pk").isNotNull() & (F.col("new_pk") != F.col("pk")) & (F.col("op") == "update")
    old, new = (ops.where(moved), ops.where(moved))
    out = ops.where(~F.coalesce(moved, F.lit(False))).withColumn("pos", F.col("pos") * 2)
    if strict:
        out = out.unionByName(old.withColumn("op", F.lit("delete")).withColumn("pos", F.col("pos") * 2))
    return out.unionByName(new.withColumn("op", F.lit("insert")).withColumn("pk", F.col("new_pk")).withColumn("pos", F.col("pos") * 2 + 1)).drop("new_pk")


def bag(ops: DataFrame, columns: list[str], by_all_columns: bool = True) -> DataFrame:
    """Tables without a key: rows pile up. ops: pos, op, columns and, of an update, the row before it as a struct
    `before` of the same columns.

    A delete takes every row that is there by then and equal to it in all columns (never one with a null, for null is
    equal to nothing). An update takes the rows equal to `before` and puts one row, as the source did; an applier
    that changes several equal rows at once would put as many as it takes, which this does not follow. With
    by_all_columns = False updates and deletes are passed over, as appliers do that want a key.

    Rows of one content meet in one aggregate: what was put there after the last taking stays.
    """
    put = ops.where(F.col("op").isin("insert", "update") if by_all_columns else F.col("op") == "insert").select("pos", *columns)
    if not by_all_columns:
        return put.select(*columns)
    taken = ops.where("op = 'delete'").select("pos", *columns)
    if "before" in ops.columns:
        taken = taken.unionByName(ops.where("op = 'update'").select("pos", *(F.col("before")[c].alias(c) for c in columns)))
    last = taken.dropna(subset=columns).groupBy(*columns).agg(F.max("pos").alias("_last"))
    return put.join(last, columns, "left").where(F.col("_last").isNull() | (F.col("pos") > F.col("_last"))).select(*columns)


def partial(ops: DataFrame, columns: tuple[str, ...] = ROW) -> DataFrame:
    """Changes with partial images: of each column the last value that was present (map `present`) since the key's
    last delete, and null if there was none. The image of a delete is no value."""
    at = lambda ok: F.max_by(F.struct("pos", "op"), F.when(ok, F.col("pos")))
    each = [F.max_by(F.struct("pos", F.col(c).alias("value")), F.when(F.element_at("present", F.lit(c)) & (F.col("op") != "delete"), F.col("pos"))).alias(c) for c in columns]
    last = ops.groupBy(*KEY).agg(at(F.col("op") != "update").alias("_born"), at(F.col("op") == "delete").alias("_dead"), *each)
    since = lambda c: F.when(F.col("_dead").isNull() | (F.col(c)["pos"] > F.col("_dead")["pos"]), F.col(c)["value"]).alias(c)
    return last.where(F.col("_born")["op"] == "insert").select(*KEY, *(since(c) for c in columns))


def surviving(ops: DataFrame, statements: DataFrame) -> DataFrame:
    """ops (pos, db, tab, ...) that no later statement (pos, kind, db, tab) emptied: TRUNCATE or DROP of their table,
    or DROP of their database. Folds of them are what is there in the end.

    Statements are summed to one row a table and one a database before changes meet them.
    """
    table = statements.where("kind in ('ddl_truncate_table', 'ddl_drop_table')").groupBy("db", "tab").agg(F.max("pos").alias("_emptied"))
    database = statements.where("kind = 'ddl_drop_database'").groupBy("db").agg(F.max("pos").alias("_dropped"))
    met = ops.join(table, ["db", "tab"], "left").join(database, "db", "left")
    return met.where((F.col("pos") > F.coalesce("_emptied", F.lit(-2))) & (F.col("pos") > F.coalesce("_dropped", F.lit(-2)))).select(*ops.columns)


def _next_statement(df: DataFrame, key: Column, statements: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the position of the first of `statements` behind key (2 * pos for what stands at pos, 2 * pos + 2 for what
    stands behind it) that is about the same table (or database)."""
    both = df.withColumn("_k", -key).unionByName(statements.select((-2 * F.col("pos") - 1).alias("_k"), *by, F.col("pos").alias("_own")), allowMissingColumns=True)
    seen = with_running(both, "_k", -F.col("_own"), "_seen", by, "max")
    return seen.where("_own is null").withColumn(name, -F.col("_seen")).drop("_k", "_own", "_seen")


def _next(df: DataFrame, key: Column, statements: DataFrame) -> DataFrame:
    tables, bases = statements.where("kind <> 'ddl_drop_database'"), statements.where("kind = 'ddl_drop_database'")
    own = _next_statement(df, key, tables, ["db", "tab"], "_table")
    return _next_statement(own, key, bases, ["db"], "_base").withColumn("_next", F.least("_table", "_base")).drop("_table", "_base")


def followed(ops: DataFrame, statements: DataFrame) -> DataFrame:
    """ops (pos, db, tab, ...) under the names that their tables have in the end, without what statements took away.

    statements: pos (one each), kind, db, tab, new_db, new_tab. TRUNCATE and DROP of a table and DROP of a database take
    the changes at or before them; RENAME TABLE gives them another name, under which later statements find them. Other kinds are passed over.

    Every statement points to the next one about the table it leaves; pointers are doubled till each knows what becomes
    of it in the end, in as many rounds as the logarithm of the longest chain of renames. Changes then look
    for their first statement alone.
    """
    of = statements.where("kind in ('ddl_rename_table', 'ddl_truncate_table', 'ddl_drop_table', 'ddl_drop_database')").select("pos", "kind", "db", "tab", "new_db", "new_tab")
    left = of.select("pos", (F.col("kind") == "ddl_rename_table").alias("lives"), F.col("new_db").alias("db"), F.col("new_tab").alias("tab"))
    onward = _next(left.where("lives"), 2 * F.col("pos") + 2, of)
    fate = kept(onward.unionByName(left.where("not lives"), allowMissingColumns=True), "statements")
    while not fate.where("_next is not null").isEmpty():
        then = fate.select(F.col("pos").alias("_at"), F.struct("lives", "db", "tab", "_next").alias("_then"))
        met = fate.join(then, F.col("_next") == F.col("_at"), "left")
        fate = kept(met.select("pos", *(F.when(F.col("_next").isNull(), F.col(c)).otherwise(F.col("_then")[c]).alias(c) for c in ("lives", "db", "tab", "_next"))), "statements")
    end = fate.select(F.col("pos").alias("_next"), F.struct("lives", "db", "tab").alias("_end"))
    met = _next(ops, 2 * F.col("pos"), of).join(end, "_next", "left").where("_end is null or _end.lives")
    return met.select(*(F.coalesce(F.col("_end")[c], F.col(c)).alias(c) if c in ("db", "tab") else F.col(c) for c in ops.columns))

