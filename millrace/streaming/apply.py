"""Streaming: changes as they come, seen once, applied by batch.

State is one number per server, in the marks of the batch before. Data and checkpoint of a batch are one versioned folder, so a batch
that is run again writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import fold
from millrace.operators.filters import after_position, file_order
from millrace.operators.gtid import first_seen, high_water, start_after
from millrace.sources import binlog, textlog


def not_applied(batch: DataFrame, marks: DataFrame) -> DataFrame:
    """The changes of a batch whose transactions are above their server's mark, each sent once.

    What is ordered is one row per transaction, not the changes, so a server that sends everything is no single task's work. A transaction must not go on
    in the next batch; binary logs end files between transactions.
    """
    trx = batch.groupBy("server_uuid", "trx_id", "trx_no").agg(F.min("pos").alias("pos"))
    new = start_after(first_seen(trx), marks).select("server_uuid", "trx_no")
    return batch.join(new, ["server_uuid", "trx_no"], "left_semi")


def apply_to(folder: str, compact_every: int = 20, skip_applied: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a table as versions: folder/changes/v=N has the last change of each
    key in batch N, folder/marks/v=N the transaction marks applied by then. A batch writes what it
    changes, not the table; with skip_applied it leaves out transactions applied before; every compact_every batches the changes since the last time are folded into
    folder/rows/v=N. Running a batch again gives the same folders."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/marks/v={number - 1}") if number > 0 else None
        if skip_applied:
            batch = not_applied(batch, high_water(batch).limit(0) if before is None else before)
        marks = high_water(batch)
        if before is not None:
            marks = marks.union(before).groupBy("server_uuid").agg(F.max("mark").alias("mark"))
        fold.last_changes(batch).write.mode("overwrite").parquet(f"{folder}/changes/v={number}")
        if (number + 1) % compact_every == 0:
            snapshot(spark, folder, number, compact_every, compacted=False).write.mode("overwrite").parquet(f"{folder}/rows/v={number}")
        marks.write.mode("overwrite").parquet(f"{folder}/marks/v={number}")

    return run


def snapshot(spark: SparkSession, folder: str, number: int, compact_every: int = 20, compacted: bool = True) -> DataFrame:
    """The table after batch `number`: the last compacted rows and the changes since."""
    done = (number + 1) // compact_every * compact_every - 1 if compacted else number // compact_every * compact_every - 1
    later = [f"{folder}/changes/v={n}" for n in range(done + 1, number + 1)]
    if not later:
        return spark.read.parquet(f"{folder}/rows/v={done}")
    ops = spark.read.parquet(*later)
    return fold.replace(fold.with_base(ops, spark.read.parquet(f"{folder}/rows/v={done}")) if done >= 0 else ops)


def fan_out(sinks: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One stream, several destinations in lock-step: a batch ends when all have taken it."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return run


def fan_out_each(sinks: dict[str, Callable[[DataFrame, int], None]], folder: str, begin: DataFrame) -> Callable[[DataFrame, int], None]:
    """One stream, several destinations (by name) that have come to different transactions: each skips what its own marks show as applied.

    begin: destination, server_uuid, mark; what each had before the first batch. Start the stream at gtid.merge_min of these, so
    that none misses anything. The marks of all destinations are one version, folder/marks/v=N, written when all have taken batch N: a
    batch that is cut short is run again for all of them, from the marks before.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/marks/v={number - 1}") if number > 0 else begin.select("destination", "server_uuid", "mark")
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                own = before.where(F.col("destination") == name).select("server_uuid", "mark")
                sink(not_applied(batch, own), number)
            names = F.explode(F.array(*map(F.lit, sinks))).alias("destination")
            new = high_water(batch).select(names, "server_uuid", "mark")
            marks = before.unionByName(new).groupBy("destination", "server_uuid").agg(F.max("mark").alias("mark"))
            marks.write.mode("overwrite").parquet(f"{folder}/marks/v={number}")
        finally:
            batch.unpersist()

    return run


def run_available(ops: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs the stream over all there is and ends; the number of the last batch, -1 if there was none."""
    last = {"n": -1}

    def counted(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        last["n"] = number

    query = ops.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last["n"]


def stream_logs(spark: SparkSession, folder: str, files_at_once: int = 100, names: str = "*") -> DataFrame:
    """Binary log files as they come into a folder, oldest first. A file is taken once, so only files that are closed (rotated) belong there."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", names).load(folder)


def log_changes(files: DataFrame, row: str, start: tuple[str, int] | None = None, marks: DataFrame | None = None) -> DataFrame:
    """The operation log of binary log files (path, content). row: the columns of a row image, as a schema.

    Where it begins: with the first file; at start, a (file, position), of which the table maps before it still hold; or
    after marks, the last transaction of each server. start = log_end() leaves out all there is so far.
    """
    rows = binlog.oplog_of(files, last_only=True)
    if start is not None:
        rows = after_position(rows, *start)
    image = F.from_json(F.coalesce("after", "before"), row)
    ops = binlog.in_one_order(rows).withColumn("row", image).select("pos", "server_uuid", "trx_id", F.col("gtid_pos").alias("trx_no"), "last_committed", "db", "tab", "op", "row.*")
    return ops if marks is None else start_after(ops, marks)


def log_end(spark: SparkSession, folder: str, names: str = "*") -> tuple[str, int] | None:
    """Name and length of the last log file of a folder, by listing alone; None for an empty one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select(F.substring_index("path", "/", -1).alias("file"), "length")
    last = files.agg(F.max_by(F.struct("file", "length"), file_order(F.col("file"))).alias("last")).first()["last"]
    return last and (last["file"], last["length"])


def of_logs(sink: Callable[[DataFrame, int], None], row: str, start: tuple[str, int] | None = None, marks: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of batches of log files out of one of batches of changes."""
    return lambda files, number: _read_once(sink, log_changes(files, row, start, marks), number)


def _read_once(sink: Callable[[DataFrame, int], None], batch: DataFrame, number: int) -> None:
    """A sink looks at a batch several times; its files are decoded for the first."""
    batch = batch.persist()
    try:
        sink(batch, number)
    finally:
        batch.unpersist()


def in_order(spark: SparkSession, folder: str) -> None:
    """Gives the files of a folder times in the order of their names, as a server leaves them that closes one after the other. Streams
    take files by their times, and what comes in another order than the log's is taken for applied before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(path) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda p: p.getName())
    begin = max((fs.getFileStatus(p).getModificationTime() for p in files), default=0) // 1000 - len(files)
    for k, p in enumerate(files):
        fs.setTimes(p, (begin + k) * 1000, -1)
    times = [fs.getFileStatus(p).getModificationTime() for p in files]
    if times != sorted(set(times)):
        raise ValueError(f"{folder}: its file system keeps no times that are set")


def stream_text(spark: SparkSession, folder: str, files_at_once: int = 100, names: str = "*") -> DataFrame:
    """Records of textual logs as their files come into a folder: src_file, record. A file is taken once and whole."""
    lines = spark.readStream.option("lineSep", "\n# at ").option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", names).text(folder)
    return lines.select(F.col("_metadata.file_name").alias("src_file"), F.col("value").alias("record"))


def of_text(sink: Callable[[DataFrame, int], None], row: str, marks: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of batches of records of textual logs out of one of batches of changes. row: the wanted columns of a row, as a schema; a deleted row has
    its values before. marks: as in log_changes."""

    def run(records: DataFrame, number: int) -> None:
        rows = binlog.in_one_order(textlog.oplog(textlog.parse(records), row))
        image = F.coalesce("after", "before")
        ops = rows.withColumn("row", image).select("pos", "ts", "server_uuid", "trx_id", F.col("gtid_pos").alias("trx_no"), "last_committed", "db", "tab", "op", "row.*")
        _read_once(sink, ops if marks is None else start_after(ops, marks), number)

    return run


def stream_table(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
