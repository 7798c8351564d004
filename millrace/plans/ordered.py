"""Totals and neighbours along one long order, without one long window.

A window without a partition runs in one task. Here the order is cut into buckets of its key: windows
run inside buckets, and only one row per bucket (its last value, its sum) goes through a second
window, whose result is joined back to the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _bucketed(df: DataFrame, order: str, by: list[str], width: int):
    own = df.withColumn("_o_bucket", F.floor(F.col(order) / width))
    return own, Window.partitionBy(*by, "_o_bucket").orderBy(order), (Window.partitionBy(*by) if by else Window).orderBy("_o_bucket")


def _carried(df: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """Joins the bucket's carry; keys may be null."""
    keys = [*by, "_o_bucket"]
    renamed = carry.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_o_carry")
    match = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return df.join(renamed, cond, "left").drop(*(f"_{i}" for i in range(len(keys))))


def with_previous(df: DataFrame, order: str, value: Column, name: str, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """df with `value` of the row before, by `order` (distinct in each `by`); null for the first."""
    by = by or []
    own, inside, across = _bucketed(df.withColumn("_o_value", value), order, by, width)
    last = own.groupBy(*by, "_o_bucket").agg(F.max_by(F.struct("_o_value"), order).alias("_o_last"))
    carry = last.withColumn("_o_carry", F.lag("_o_last").over(across)).drop("_o_last")
    own = own.withColumn("_o_first", F.row_number().over(inside) == 1).withColumn("_o_prev", F.lag("_o_value").over(inside))
    return _carried(own, carry, by).withColumn(name, F.when(F.col("_o_first"), F.col("_o_carry._o_value")).otherwise(F.col("_o_prev"))).drop("_o_value", "_o_bucket", "_o_first", "_o_prev", "_o_carry")


def with_running(df: DataFrame, order: str, value: Column, name: str, by: list[str] | None = None, how: str = "sum", before: bool = False, width: int = WIDTH) -> DataFrame:
    """df with the running sum or max of `value` along `order`, this row included or (before) not."""
    by = by or []
    agg = {"sum": F.sum, "max": F.max}[how]
    own, inside, across = _bucketed(df.withColumn("_o_value", value), order, by, width)
    sums = own.groupBy(*by, "_o_bucket").agg(agg("_o_value").alias("_o_all"))
    carry = sums.withColumn("_o_carry", agg("_o_all").over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("_o_all")
    own = own.withColumn("_o_own", agg("_o_value").over(inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)))
    joined = _carried(own, carry, by)
    if how == "sum":
        out = F.coalesce("_o_own", F.lit(0)) + F.coalesce("_o_carry", F.lit(0))
    else:
        out = F.greatest("_o_own", "_o_carry")
    return joined.withColumn(name, out).drop("_o_value", "_o_bucket", "_o_own", "_o_carry")
