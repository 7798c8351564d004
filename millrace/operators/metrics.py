"""Counters, gauges and rates of an operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("insert", "update", "delete")


def change_counters(ops: DataFrame, accepted: Column) -> DataFrame:
    """db, tab, and per kind of change how many were applied and how many skipped, zeros included."""
    counts = [F.count_if((F.col("op") == op) & ok).alias(f"dml_{op}{end}_total") for op in OPS for end, ok in (("", accepted), ("_skip", ~accepted))]
    return ops.groupBy("db", "tab").agg(*counts)


def statement_counters(named: DataFrame, accepted: Column) -> DataFrame:
    own = named.where(F.col("kind").startswith("ddl"))
    of_db = F.col("kind").endswith("database")
    return own.groupBy("db", "tab").agg(*(F.count_if(of & ok).alias(f"ddl_{what}{end}_total") for what, of in (("database", of_db), ("table", ~of_db)) for end, ok in (("", accepted), ("_skip", ~accepted))))


def totals(ops: DataFrame) -> DataFrame:
    """op (null: all), n."""
    return ops.groupingSets([["op"], []], "op").agg(F.count("*").alias("n"))


def transaction_counters(groups: DataFrame) -> DataFrame:
    """trx: transactions; merge_trx: commits of groups."""
    return groups.agg(F.count("*").alias("trx"), F.count_distinct("gid").alias("merge_trx"))


# The statements that are counted by name.
NON_DML = ("createdatabase", "dropdatabase", "alterdatabase", "createtable", "altertable", "droptable", "renametable", "truncatetable", "createindex")


def operation_counters(ops: DataFrame, named: DataFrame, ops_ok: Column, named_ok: Column) -> DataFrame:
    """One row: what was read of each kind of change and statement, what of it was applied and what skipped, and both sums."""
    of_db = F.col("kind").endswith("database")
    read = ops.select(F.concat(F.lit("dml_"), "op").alias("kind"), ops_ok.alias("ok")).union(
        named.where(F.col("kind").startswith("ddl")).select(F.when(of_db, "ddl_database").otherwise("ddl_table").alias("kind"), named_ok.alias("ok"))
    )
    kinds = [*(f"dml_{op}" for op in OPS), "ddl_database", "ddl_table"]
    sides = (("extractor_operation", "", F.lit(True)), ("applier_operation", "", F.col("ok")), ("applier_operation", "_skip", ~F.col("ok")))
    each = [F.count_if((F.col("kind") == kind) & ok).alias(f"{side}_{kind}{end}_total") for side, end, ok in sides for kind in kinds]
    return read.agg(F.count("*").alias("extractor_operations"), F.count_if("ok").alias("applier_operations"), *each)


def replication_counters(ops: DataFrame, named: DataFrame, groups: DataFrame, ops_ok: Column) -> DataFrame:
    """One row: dml_*, nondml (the sum) and nondml_* by statement, trx, merge_trx (commits of groups), and delay, the
    seconds from the last change applied to the last one read."""
    none = F.lit(None).cast("long")
    second = F.unix_timestamp("ts")
    read = ops.select(F.concat(F.lit("dml_"), "op").alias("what"), second.alias("read"), F.when(ops_ok, second).alias("applied"))
    read = read.union(named.where(F.col("kind").startswith("ddl")).select(F.concat(F.lit("nondml_"), F.replace(F.replace("kind", F.lit("ddl_")), F.lit("_"))), none, none))
    read = read.union(groups.select(F.lit("trx"), none, none)).union(groups.select("gid").distinct().select(F.lit("merge_trx"), none, none))
    each = [F.count_if(F.col("what") == what).alias(what) for what in (*(f"dml_{op}" for op in OPS), *(f"nondml_{s}" for s in NON_DML), "trx", "merge_trx")]
    nondml = F.count_if(F.col("what").isin(*(f"nondml_{s}" for s in NON_DML))).alias("nondml")
    return read.agg(*each, nondml, (F.max("read") - F.max("applied")).alias("delay"))


def gauges(ops: DataFrame) -> DataFrame:
    """server_uuid, last position, its time, and the last transaction number of each server."""
    return ops.groupBy("server_uuid").agg(F.max("pos").alias("binlog_pos"), F.max_by("ts", "pos").alias("last_ts"), F.max_by("trx_id", "pos").alias("last_gno"))


def as_json(counters: DataFrame) -> DataFrame:
    """One row: all counters as one JSON object."""
    return counters.agg(F.to_json(F.struct(*(F.sum(c).cast("long").alias(c) for c, kind in counters.dtypes if kind == "bigint"))).alias("metrics"))


def number_rate(ops: DataFrame, seconds: int) -> DataFrame:
    """server_uuid, poll (start of each interval), mark, rate: transaction numbers a second since the poll before."""
    poll = (F.floor(F.unix_timestamp("ts") / seconds) * seconds).cast("long")
    marks = ops.groupBy("server_uuid", poll.alias("poll")).agg(F.max("trx_id").alias("mark"))
    order = Window.partitionBy("server_uuid").orderBy("poll")
    rate = (F.col("mark") - F.lag("mark").over(order)) / (F.col("poll") - F.lag("poll").over(order))
    return marks.select("server_uuid", "poll", "mark", F.round(rate, 6).alias("rate"))


def delay_alert(delays: DataFrame, at_least: int = 10, for_seconds: int = 60, step: int | None = None) -> DataFrame:
    """db, second, delay, firing: whether max(delay - 1, 0) has been at_least for for_seconds without a break.

    delays: db, second (epoch), delay. It takes a sample for_seconds ago or earlier and none too low since: one that
    begins just now is pending, not firing. A gap of more than `step` seconds between samples (if given) breaks a run.
    Delays are first made one sample a second, so the windows grow with time, not with the number of changes.
    """
    sampled = delays.groupBy("db", "second").agg(F.max("delay").alias("delay"))
    order = Window.partitionBy("db").orderBy("second")
    low = F.greatest(F.col("delay") - 1, F.lit(0)) < at_least
    gap = F.col("second") - F.lag("second").over(order) > step if step is not None else F.lit(False)
    seen = sampled.withColumn("_low", low).withColumn("_opens", F.coalesce(low | F.lag(low).over(order) | gap, F.lit(True)))
    # The first sample of the run that a sample stands in.
    began = F.max(F.when(F.col("_opens"), F.col("second"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("_began", began).select("db", "second", "delay", (~F.col("_low") & (F.col("second") - F.col("_began") >= for_seconds)).alias("firing"))
