"""Filters: which operations a destination takes, which events a reader gives."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_DB = "mysql"


@dataclass(frozen=True)
class Replicate:
    """Names are exact and case-sensitive; tables are written db.table. An empty do-list takes all."""

    do_db: tuple[str, ...] = ()
    ignore_db: tuple[str, ...] = ()
    do_table: tuple[str, ...] = ()
    ignore_table: tuple[str, ...] = ()

    def accepts(self, db: Column, tab: Column) -> Column:
        """First what is ignored, then what is not asked for. Plain IN lists reach the scan."""
        full = F.concat_ws(".", F.coalesce(db, F.lit("")), F.coalesce(tab, F.lit("")))
        db = F.coalesce(db, F.lit(""))
        out = ~db.isin(SYSTEM_DB, *self.ignore_db)
        if self.ignore_table:
            out = out & ~full.isin(*self.ignore_table)
        if self.do_db:
            out = out & db.isin(*self.do_db)
        if self.do_table:
            out = out & full.isin(*self.do_table)
        return out


def replicate(ops: DataFrame, rule: Replicate) -> DataFrame:
    return ops.where(rule.accepts(F.col("db"), F.col("tab")))


def replicate_statements(statements: DataFrame, rule: Replicate, compat: bool = False) -> DataFrame:
    """Statements of tables pass by their own table; those of users by the schema they ran in alone.

    compat: a table statement also has to pass as (its schema context, no table), as older
    appliers ask; with do_table set, that turns all of them away.
    """
    context, none = F.col("schema_ctx"), F.lit("")
    own = rule.accepts(F.col("db"), F.col("tab"))
    if compat:
        own = own & rule.accepts(context, none)
    schema_only = Replicate(do_db=rule.do_db, ignore_db=rule.ignore_db)
    users = rule.accepts(context, none) if compat else schema_only.accepts(context, none)
    return statements.where(F.when(F.col("kind").startswith("user"), users).otherwise(own))


def reader(ops: DataFrame, only_schemas=(), ignored_schemas=(), only_tables=(), ignored_tables=(), only_ops=(), ignored_ops=()) -> DataFrame:
    """A reader's filters; tables without their schema. An only-list wins over an ignore-list."""
    for column, only, ignored in (("db", only_schemas, ignored_schemas), ("tab", only_tables, ignored_tables), ("op", only_ops, ignored_ops)):
        if only:
            ops = ops.where(F.col(column).isin(*only))
        elif ignored:
            ops = ops.where(~F.col(column).isin(*ignored))
    return ops


def from_timestamp(ops: DataFrame, at: datetime) -> DataFrame:
    return ops.where(F.col("ts") >= F.lit(at))


def up_to_position(ops: DataFrame, end: int, start: str = "start_pos") -> DataFrame:
    """Events that begin before the bound: the one that crosses it is the last."""
    return ops.where(F.col(start) < end)


def file_order(file: Column) -> Column:
    """What log files are put in order by: a name with more digits is the later one of two with one beginning."""
    return F.struct(F.length(file).alias("n"), file.alias("file"))


def after_position(ops: DataFrame, file: str, pos: int) -> DataFrame:
    """What follows a (file, position) checkpoint."""
    own, last = file_order(F.col("src_file")), file_order(F.lit(file))
    return ops.where((own > last) | ((F.col("src_file") == file) & (F.col("pos") >= pos)))
