"""What the training-data operators share: input tables, shared files, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: no ASCII white space in it. The same set is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write: spark.checkpoint.dir of the session.

    Only where a local session names none is a temporary one set; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    It cuts the lineage at a stage that several later ones read: a lost executor then costs
    a read of replicated files, not another run of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this process has materialized. Call it when results that read them are
    written; on a cluster they stay in the shared folder otherwise."""
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns of these names put into one struct column, out of an operator's way; and what takes
    the operator's result back to the columns of docs, as they were."""
    held, columns = [c for c in docs.columns if c in names], docs.columns
    put = docs.withColumn("__own", F.struct(*held)).drop(*held) if held else docs
    return put, lambda done: done.select(*(F.col("__own")[c].alias(c) if c in held else F.col(c) for c in columns))


def id_remainder(column: str, of: int) -> Column:
    """crc32 of the id written as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def word_count(text: Column) -> Column:
    """Words of a text, as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file. MILLRACE_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("MILLRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
