"""Commit groups, gaps and order checks of a log that comes in batches: each carries one row of state into the next.

What a batch writes is a version (v=N) of each folder; its state is written last, so a batch that was cut short is run again from the state
before and writes the same folders. Batch and stream give the same rows, however the log is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import gtid, transactions

HEARTBEAT = "heartbeat"
_STATE = "end long, gid long, last_committed long, open_from long, beats long"


def with_heartbeats(log: DataFrame, seconds: int = 1) -> DataFrame:
    """A stream of transactions with heartbeats between them, one every so many seconds, so that batches come while the log is idle."""
    beats = log.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    beats = beats.where(F.col("value") % seconds == 0).select(F.lit(HEARTBEAT).alias("kind"))
    return log.withColumn("kind", F.lit("trx")).unionByName(beats, allowMissingColumns=True)


def apply_groups(folder: str, beats: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of transactions, one a row: kind (`heartbeat` for a row that is none), pos, trx_no, server_uuid, trx_id, last_committed, and
    optionally barrier (true where a statement stands right before it) and others.

    groups/v=N: transactions of the groups that batch N closes, with gid (from 1 along the log) and flush: `next` where the following group
    begins, `idle` where the log fell silent. The last group stays open over batches, its rows in open/v=N, each written once. When `beats`
    heartbeats have come since the last transaction, over one batch or several, the open group is closed;
    what comes behind it is another group, even of the same last_committed.

    gaps/v=N: server_uuid, missing_from, missing_to: numbers that a server has passed over, once above its mark of before. late/v=N:
    transactions that are not taken, with reason: `again` (at or below their server's mark, or a second time), or `order` (trx_no at or before
    the end of an earlier batch, from a file that came late). marks/v=N: the last number of each server. Transactions without
    server or number are never `again`. No order runs by server alone, so a server may send everything.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(_STATE).parquet(f"{folder}/state/v={number - 1}").first() if number > 0 else None
        end, gid, silent = (state.end, state.gid, state.beats) if state else (None, 0, 0)
        opened = state.open_from if state else None
        batch = batch.persist()

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}/v={number}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}/v={number}")

        try:
            trx = batch.where(F.col("kind") != HEARTBEAT).drop("kind")
            marks = spark.read.parquet(f"{folder}/marks/v={number - 1}") if number > 0 else gtid.high_water(trx).limit(0)
            on_time = trx.where(F.coalesce(F.col("trx_no") > F.lit(end), F.lit(True)))
            named = F.col("server_uuid").isNotNull() & F.col("trx_id").isNotNull()
            new = gtid.start_after(gtid.first_seen(on_time.where(named)), marks).select(*trx.columns).unionByName(on_time.where(~named))
            # The open group is one row before the batch: all it takes to tell where the next begins.
            last = spark.createDataFrame([(end, state.last_committed, True)] if opened is not None else [], "trx_no long, last_committed long, _carried boolean")
            barrier = F.coalesce(F.col("barrier"), F.lit(False)) if "barrier" in trx.columns else None
            seen = new.withColumn("_carried", F.lit(False)).unionByName(last, allowMissingColumns=True)
            first = gid - 1 if opened is not None else gid
            grouped = put(transactions.commit_groups(seen, barrier).where("not _carried").drop("_carried").withColumn("gid", F.col("gid") + first), "grouped")
            reason = F.when(F.coalesce(F.col("trx_no") > F.lit(end), F.lit(True)), "again").otherwise("order")
            put(trx.join(grouped.select("pos"), "pos", "left_anti").select(*trx.columns, reason.alias("reason")), "late")
            numbers = grouped.where(named).select("server_uuid", "trx_id")
            put(gtid.gaps(numbers.unionByName(marks.withColumnRenamed("mark", "trx_id"))), "gaps")
            put(gtid.high_water(numbers).unionByName(marks).groupBy("server_uuid").agg(F.max("mark").alias("mark")), "marks")

            now = grouped.agg(F.max("trx_no").alias("end"), F.max("gid").alias("gid"), F.max_by("last_committed", "trx_no").alias("last_committed")).first()

            if now.end is not None:
                closes, open_rows = now.gid > gid, grouped.where(F.col("gid") == now.gid)
                done, why, silent = grouped.where(F.col("gid") < now.gid), "next", 0
                after = (now.end, now.gid, now.last_committed, number if closes or opened is None else opened, 0)
            else:
                silent += batch.where(F.col("kind") == HEARTBEAT).count()
                closes, open_rows, done, why = silent >= beats and opened is not None, grouped, grouped, "idle"
                after = (end, gid, None if closes else state and state.last_committed, None if closes else opened, silent)
            if closes and opened is not None:
                done = done.unionByName(spark.read.parquet(*(f"{folder}/open/v={n}" for n in range(opened, number))))
            put(done.withColumn("flush", F.lit(why)), "groups")
            put(open_rows, "open")
            put(spark.createDataFrame([after], _STATE).coalesce(1), "state")
        finally:
            batch.unpersist()

    return run


def _all(spark: SparkSession, folder: str, name: str, number: int) -> DataFrame:
    return spark.read.parquet(*(f"{folder}/{name}/v={n}" for n in range(number + 1)))


def groups(spark: SparkSession, folder: str, number: int, with_open: bool = False) -> DataFrame:
    """The transactions of all groups closed by batch `number`; with_open: those of the open group too, with flush null."""
    done = _all(spark, folder, "groups", number)
    state = spark.read.schema(_STATE).parquet(f"{folder}/state/v={number}").first()
    if not with_open or state.open_from is None:
        return done
    left = spark.read.parquet(*(f"{folder}/open/v={n}" for n in range(state.open_from, number + 1)))
    return done.unionByName(left.withColumn("flush", F.lit(None).cast("string")))


def gaps(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """What servers had passed over by batch `number`."""
    return _all(spark, folder, "gaps", number)


def late(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """What was not taken by batch `number`, with its reason."""
    return _all(spark, folder, "late", number)


def check_order(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of entries (seq, kind): violations/v=N has those of a batch that may not stand behind the one before them, as
    `transactions.order_violations` has, where the first of a batch follows the last of the batches before. Entries at or before that one
    came late: they are in violations too, with prev `late`, and do not count as the entry before any."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/last/v={number - 1}") if number > 0 else batch.select("seq", "kind").limit(0)
        carried = before.first()
        seq = carried.seq if carried else None
        is_late = F.coalesce(F.col("seq") <= F.lit(seq), F.lit(False))
        entries = batch.select("seq", "kind").where(~is_late).unionByName(before)
        wrong = transactions.order_violations(entries)
        wrong = wrong.where(F.col("seq") > F.lit(seq)) if carried else wrong
        came_late = batch.where(is_late).select("seq", F.lit("late").alias("prev"), "kind")
        wrong.unionByName(came_late).write.mode("overwrite").parquet(f"{folder}/violations/v={number}")
        last = entries.agg(F.max(F.struct("seq", "kind")).alias("last")).where("last is not null").select("last.*")
        last.write.mode("overwrite").parquet(f"{folder}/last/v={number}")

    return run


def violations(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return _all(spark, folder, "violations", number)
