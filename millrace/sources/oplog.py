"""The operation log: one row per row change, in the order of the log.

pos, ts, trx_no, server_uuid, trx_id (the number in a global transaction id), last_committed, db, tab, op (insert,
update, delete), pk, value, props. derived() reads such a log out of a table of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(events: DataFrame) -> DataFrame:
    """Four changes a transaction, five transactions a commit group, three servers."""
    trx = F.floor(F.col("event_id") / 4.0).cast("long")
    user = F.col("user_id") % 10
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("pos"), "ts", trx.alias("trx_no"),
        F.concat(F.lit("0000000"), (trx % 3).cast("string"), F.lit("-0000-4000-8000-000000000000")).alias("server_uuid"),
        (F.floor(trx / 3.0).cast("long") + 1).alias("trx_id"), (F.floor(trx / 5.0).cast("long") * 5).alias("last_committed"),
        F.when(user == 9, "mysql").when(user == 8, "audit").otherwise("shop").alias("db"),
        F.when(F.col("user_id") % 2 == 0, "users").otherwise("carts").alias("tab"),
        F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update").alias("op"),
        F.col("user_id").alias("pk"), "value", "props",
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    return derived(table(spark, folder, "events"))


def transactions(ops: DataFrame) -> DataFrame:
    """One row per transaction: trx_no, server_uuid, trx_id, last_committed, pos (of its first change), n_ops."""
    return ops.groupBy("trx_no", "server_uuid", "trx_id", "last_committed").agg(F.min("pos").alias("pos"), F.count("*").alias("n_ops"))
