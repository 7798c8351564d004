"""Documents to packed training sequences: five stages, each an operator of millrace.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, as they came where a stage does not
change them; columns of docs named like an operator's own are set aside meanwhile. Names that begin with two
underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fm_quality, lsh_forest, mixing, packing, surrogates
from millrace.llm._shared import aside, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    machine = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    own, back = aside(docs, {"held_out", "score", "predicted", "_n"})
    return back(fm_quality.score(own, machine).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays; of
    repeated rows (one id, one text) one stays. Two texts under one id are two documents. Rows with a null id all stay."""
    nothing = F.col("doc_id").isNull()
    of = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "__text": lsh_forest.text_key(F.col("text")), "__none": nothing})
    gone = lsh_forest.near_duplicates(docs.select("doc_id", "text")).where("not first")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), F.lit(False).alias("__none")).distinct()
    return of.dropDuplicates(["__id", "__text", "__none"]).join(gone, ["__id", "__text", "__none"], "left_anti").select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars is counted anew where there were any."""
    own, back = aside(docs, {"n_entities"})
    done = surrogates.replace_entities(own)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(done)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    own, back = aside(docs, {"size", "source_size", "target", "copies"})
    return back(mixing.mix(own).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model, a forest and random rounding: SQL has no form of these stages; tests/llm holds them
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
