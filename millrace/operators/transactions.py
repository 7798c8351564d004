"""Transactions: commit groups by logical clock, statement barriers, order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import with_previous, with_running
from millrace.plans.search import first_reaching
from millrace.plans.shared import kept

# Which kind may follow which.
FOLLOWS = {
    "gtid": ("", "xid", "ddl", "dcl"),
    "ddl_database": ("gtid",),
    "ddl_table": ("gtid", "ddl"),
    "dcl": ("gtid", "dcl"),
    "begin": ("gtid",),
    "dml": ("begin", "dml"),
    "xid": ("begin", "dml"),
}


def commit_groups(trx: DataFrame, barrier: Column | None = None) -> DataFrame:
    """trx with gid: transactions in a row with one last_committed are one group. barrier: true where a statement stands
    right before a transaction; what is pending is applied before a statement, so a group ends there."""
    seen = with_previous(trx, "trx_no", F.col("last_committed"), "_prev")
    opens = F.coalesce((F.col("last_committed") != F.col("_prev")).cast("long"), F.lit(1).cast("long"))
    if barrier is not None:
        opens = F.when(barrier, F.lit(1).cast("long")).otherwise(opens)
    return with_running(seen, "trx_no", opens, "gid").drop("_prev")


def _place(groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """groups with _place, from 0 along trx_no in each `by`; a group of any length is no single task's work."""
    return with_running(groups, "trx_no", F.lit(1).cast("long"), "_place", list(by), before=True)


def capped_groups(groups: DataFrame, max_count: int, by: tuple[str, ...] = ("gid",)) -> DataFrame:
    """Groups with a flush after every max_count transactions: part, from 0 in each group."""
    return _place(groups, by).withColumn("part", F.floor(F.col("_place") / max_count).cast("long")).drop("_place")


def flushed_groups(groups: DataFrame, max_delay: int, max_count: int | None = None, at: str = "at", clock: int | None = None) -> DataFrame:
    """groups with batch: which flush (from 1, along trx_no) a transaction is applied with.

    A batch ends where its group does. Else, when a transaction starts, what is pending is flushed if it is max_count
    transactions, or if the last applied transaction's time (`at`, whole seconds) is max_delay or more behind the clock. The clock is the time
    of the last transaction of the flush before; `clock` is its first reading, the first transaction's time by default. Times may go
    back; a transaction without a time is never late.

    Every transaction points to the start of the batch behind the one that would start with it: the first time that reaches its own
    clock's limit is found by plans/search.py. Which of them do start a batch is found from the first of each group, by pointers that are doubled, in as
    many rounds as the logarithm of the most flushes of a group.
    """
    seen = with_running(with_previous(groups, "trx_no", F.col(at), "_clock"), "trx_no", F.lit(1).cast("long"), "_index", before=True)
    first = F.col(at) if clock is None else F.lit(clock)
    seen = kept(seen.withColumn("_clock", F.when(F.col("_index") == 0, first).otherwise(F.col("_clock"))), "flushes")
    late = first_reaching(seen.select("gid", "_index", at, "_clock"), "_index", at, F.col("_index"), F.col("_clock") + max_delay, "_late")
    ends = seen.groupBy("gid").agg(F.min("_index").alias("_begin"), (F.max("_index") + 1).alias("_end"))
    next_ = F.least(F.col("_late") + 1, F.col("_end"), *([F.col("_index") + max_count] if max_count else []))
    jumps = kept(late.join(ends, "gid").select("_index", (F.col("_index") == F.col("_begin")).alias("_starts"), F.when(next_ < F.col("_end"), next_).alias("_to")), "flushes")
    while not jumps.where("_to is not null").isEmpty():
        reached = jumps.where("_starts and _to is not null").select(F.col("_to").alias("_index")).distinct().withColumn("_hit", F.lit(True))
        then = jumps.select(F.col("_index").alias("_at"), F.col("_to").alias("_then"))
        far = jumps.where("_to is not null").join(then, F.col("_to") == F.col("_at")).select("_index", "_starts", F.col("_then").alias("_to")).unionByName(jumps.where("_to is null"))
        jumps = kept(far.join(reached, "_index", "left").select("_index", (F.col("_starts") | F.col("_hit").isNotNull()).alias("_starts"), "_to"), "flushes")
    marked = seen.join(jumps.select("_index", "_starts"), "_index")
    return with_running(marked, "_index", F.col("_starts").cast("long"), "batch").drop("_clock", "_index", "_starts")


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("gid", "last_committed").agg(F.min("trx_no").alias("first_trx"), F.count("*").alias("n_trx"), F.sum("n_ops").alias("n_ops"))


def schedule(groups: DataFrame, workers: int) -> DataFrame:
    """A parallel applier's plan: groups one after another, their transactions dealt to workers in turn."""
    return _place(groups, ("gid",)).withColumn("worker", (F.col("_place") % workers).cast("long")).drop("_place")


def epochs(ops: DataFrame, is_barrier) -> DataFrame:
    """ops with epoch: how many statements of its table came at or before each."""
    return with_running(ops, "pos", F.when(is_barrier, 1).otherwise(0).cast("long"), "epoch", ["db", "tab"])


def order_violations(entries: DataFrame) -> DataFrame:
    """Entries (seq, kind) that may not stand behind the one before them: seq, prev, kind.

    Kinds of FOLLOWS; statements of databases and tables leave the state ddl.
    """
    state = F.when(F.col("kind").startswith("ddl"), "ddl").otherwise(F.col("kind"))
    seen = with_previous(entries, "seq", state, "prev").withColumn("prev", F.coalesce("prev", F.lit("")))
    allowed = F.lit(False)
    for kind, before in FOLLOWS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("prev").isin(*before))
    return seen.where(~allowed).select("seq", "prev", "kind")
