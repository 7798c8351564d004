"""A stream of changes and statements, folded as it comes: tables emptied, dropped and renamed between changes.

One typed log: rows (kind `row`) and statements share one order. A batch's changes are kept under the names that their tables
have at its end, with that end as their position; statements are kept beside them. What later statements do
to earlier changes is worked out when the table is read or compacted, so a batch writes what it brings and no more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import fold

_STATEMENT = ("pos", "kind", "db", "tab", "new_db", "new_tab")


def _end(spark: SparkSession, folder: str, number: int) -> int | None:
    return spark.read.parquet(f"{folder}/marks/v={number}").first()["end"] if number >= 0 else None


def apply_log(folder: str, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of a typed log: pos, kind (`row`, or a statement's), op, db, tab, pk, value, props, new_db, new_tab.

    folder/changes/v=N and folder/statements/v=N are what batch N brought, folder/rows/v=N every compact_every batches the table by then. The
    mark, folder/marks/v=N, is the last position of the batch; it is written when all else is (the barrier), so a batch that
    was cut short is run again from the mark before and writes the same folders. What comes at or before the mark is
    not applied but kept in folder/late/v=N. A batch without rows keeps the mark.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = _end(spark, folder, number - 1)
        batch = batch.persist()
        try:
            late = F.coalesce(F.col("pos") <= F.lit(mark), F.lit(False))
            new, statements = batch.where(~late), batch.where(~late & (F.col("kind") != "row")).select(*_STATEMENT)
            batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/v={number}")
            statements.write.mode("overwrite").parquet(f"{folder}/statements/v={number}")
            rows = new.where("kind = 'row'").select("pos", "op", *fold.KEY, *fold.ROW)
            if not statements.isEmpty():
                rows = fold.followed(rows, spark.read.parquet(f"{folder}/statements/v={number}"))
            end = new.agg(F.coalesce(F.max("pos"), F.lit(mark), F.lit(-1)).cast("long").alias("end"))
            fold.last_changes(rows).crossJoin(F.broadcast(end)).write.mode("overwrite").parquet(f"{folder}/changes/v={number}")
            if (number + 1) % compact_every == 0:
                at = end.first()["end"]
                _changes(spark, folder, number, compact_every, number).where("op <> 'delete'").withColumn("end", F.lit(at).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/v={number}")
            end.write.mode("overwrite").parquet(f"{folder}/marks/v={number}")
        finally:
            batch.unpersist()

    return run


def _changes(spark: SparkSession, folder: str, number: int, compact_every: int, before: int) -> DataFrame:
    """The last change of each key by batch `number`, under the names of its end; from the last rows compacted before batch `before`."""
    done = before // compact_every * compact_every - 1
    later = range(done + 1, number + 1)
    kept = [spark.read.parquet(f"{folder}/rows/v={done}")] if done >= 0 else []
    if later:
        kept.append(spark.read.parquet(*(f"{folder}/changes/v={n}" for n in later)))
    every = reduce(DataFrame.unionByName, kept)
    if later:
        statements = spark.read.parquet(*(f"{folder}/statements/v={n}" for n in later))
        if not statements.isEmpty():
            # Behind the end of their own batch, whose statements have been followed.
            moved = every.withColumnRenamed("pos", "_pos").withColumn("pos", F.col("end") + 1)
            every = fold.followed(moved, statements).drop("pos").withColumnRenamed("_pos", "pos")
    return fold.last_changes(every)


def snapshot(spark: SparkSession, folder: str, number: int, compact_every: int = 20) -> DataFrame:
    """The tables after batch `number`."""
    return _changes(spark, folder, number, compact_every, number + 1).where("op <> 'delete'").select(*fold.KEY, *fold.ROW)


def late(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """What came too late to be applied, up to batch `number`: the log's rows and batch."""
    parts = [spark.read.parquet(f"{folder}/late/v={n}").withColumn("batch", F.lit(n).cast("long")) for n in range(number + 1)]
    return reduce(DataFrame.unionByName, parts)
