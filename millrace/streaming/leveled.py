"""A table kept as sorted runs in levels, so that a batch rewrites only the parts of the table that it touches.

Keys are dealt to a fixed number of parts by hash. A batch writes one run of level 0 for each part that it changes. When a part has
`fanout` runs of one level, these alone are merged into one run of the level above, so a row is written again once a level: as
many times as the logarithm of the number of batches. Other parts are left as they are.

Folders: runs/v=N/level=L/part=P is what batch N wrote; manifest/v=N names the runs that are the table after it and is written last. A
batch that was cut short is run again from the manifest before and writes the same folders. Changes come in order: those of a batch stand
behind those of earlier ones. A sink to stand behind `apply.fan_out_each`, which leaves out what was applied before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import fold


class Run(NamedTuple):
    v: int
    level: int
    part: int
    rows: int


_MANIFEST = "v long, level long, part long, rows long, parts long"


def _with_part(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(*fold.KEY), F.lit(parts)))


def manifest(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The runs that are the table after batch `number`: at most parts x levels x (fanout - 1) rows, whatever the table's size."""
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/v={number}")


def _runs(spark: SparkSession, folder: str, number: int, parts: int) -> list[Run]:
    rows = manifest(spark, folder, number).collect() if number >= 0 else []
    if any(r.parts != parts for r in rows):
        raise ValueError(f"{folder} is kept in {rows[0].parts} parts, not {parts}")
    return [Run(r.v, r.level, r.part, r.rows) for r in rows]


def _read(spark: SparkSession, folder: str, runs: Iterable[Run]) -> DataFrame:
    """The changes of some runs. Folders are named by version and level; of their parts, only those of a run are read."""
    of: dict[tuple[int, int], list[int]] = {}
    for r in runs:
        of.setdefault((r.v, r.level), []).append(r.part)
    schema = spark.read.parquet(f"{folder}/shape").schema
    columns = list(schema.names)
    if not of:
        return spark.createDataFrame([], schema)
    scan = spark.read.schema(schema.add("v", "long").add("level", "long")).option("basePath", f"{folder}/runs")
    every = scan.parquet(*(f"{folder}/runs/v={v}/level={level}" for v, level in of))
    named = [(F.col("v") == v) & (F.col("level") == level) & F.col("part").isin(*parts) for (v, level), parts in of.items()]
    return every.where(reduce(Column.__or__, named)).select(*columns)


def apply_leveled(folder: str, parts: int = 64, fanout: int = 4) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of changes (pos, op, db, tab, pk, value, props) that keeps folder as above.

    parts: as many as make a part's rows one task's work; they are fixed once the table is begun (another number raises ValueError).
    A key is one row of a run, however often a batch changes it, so parts are even. An empty batch writes a manifest
    and no run. Deletes are kept until a merge leaves nothing older in their part.
    """
    if parts < 1 or fanout < 2:
        raise ValueError("parts from 1, fanout from 2")

    def write(rows: DataFrame, number: int, level: int) -> list[Run]:
        spark, at = rows.sparkSession, f"{folder}/runs/v={number}/level={level}"
        rows.sortWithinPartitions("part", *fold.KEY).write.mode("overwrite").partitionBy("part").parquet(at)
        written = spark.read.schema(rows.schema).parquet(at).groupBy("part").agg(F.count("*").alias("n")).collect()
        return [Run(number, level, r.part, r.n) for r in written]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        runs = _runs(spark, folder, number - 1, parts)
        changes = _with_part(fold.last_changes(batch), parts)
        changes.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")
        runs += write(changes.repartition("part"), number, 0)
        level = 0
        while level <= max((r.level for r in runs), default=-1):
            here: dict[int, list[Run]] = {}
            for r in runs:
                if r.level == level:
                    here.setdefault(r.part, []).append(r)
            due = {part for part, some in here.items() if len(some) >= fanout}
            if due:
                merged = [r for r in runs if r.level == level and r.part in due]
                below = {r.part for r in runs if r.level > level}
                rows = _read(spark, folder, merged).repartition("part")
                rows = fold.last_changes(rows, ("part", *fold.KEY)).where((F.col("op") != "delete") | F.col("part").isin(*below))
                runs = [r for r in runs if r not in merged] + write(rows, number, level + 1)
            level += 1
        rows = [(*r, parts) for r in runs]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={number}")

    return run


def snapshot(spark: SparkSession, folder: str, number: int, parts: int = 64) -> DataFrame:
    """The table after batch `number`."""
    changes = _read(spark, folder, _runs(spark, folder, number, parts))
    return fold.last_changes(changes).where("op <> 'delete'").select(*fold.KEY, *fold.ROW)


def find(spark: SparkSession, folder: str, number: int, keys: DataFrame, parts: int = 64) -> DataFrame:
    """The rows of some keys (db, tab, pk) after batch `number`: only their parts are read. A key that is null or not there gives no row."""
    keys = _with_part(keys.select(*fold.KEY).distinct(), parts)
    wanted = {r.part for r in keys.select("part").distinct().collect()}
    changes = _read(spark, folder, [r for r in _runs(spark, folder, number, parts) if r.part in wanted])
    rows = fold.last_changes(changes.join(keys, ["part", *fold.KEY], "left_semi"))
    return rows.where("op <> 'delete'").select(*fold.KEY, *fold.ROW)


def drop_unused(spark: SparkSession, folder: str, number: int) -> int:
    """Deletes versions before batch `number` of which its manifest names no run, and the manifests before it; how many versions went. Readers of earlier
    batches have to be done."""
    live = {r.v for r in manifest(spark, folder, number).select("v").distinct().collect()}
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for kind, kept in (("runs", live), ("manifest", set())):
        base = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
        fs = base.getFileSystem(conf)
        for status in fs.listStatus(base):
            v = int(status.getPath().getName().removeprefix("v="))
            if v < number and v not in kept:
                gone += bool(fs.delete(status.getPath(), True)) and kind == "runs"
    return gone
