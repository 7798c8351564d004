"""Finding the next row that reaches a value, along an order without gaps.

A window that looks ahead for "the first value of at least so much" runs over all rows behind. Here the order is cut into nodes of
`width` values, each one array; the nodes' largest values are cut again, up to one node. A search looks into its own node,
goes up while nothing there is large enough, and down to the value: every step is a join by node, so no step
reads more than one node a search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.shared import kept

WIDTH = 256


def _levels(rows: DataFrame, index: str, value: str, width: int) -> list[DataFrame]:
    """Trees of (node, values), the leaves first; the last level has one node at most."""
    one, out = rows.select(F.col(index).alias("at"), F.col(value).alias("value")), []
    while True:
        node = one.groupBy(F.floor(F.col("at") / width).cast("long").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
        out.append(kept(node, "tree"))
        if out[-1].where("node > 0").isEmpty():
            return out
        one = out[-1].select(F.col("node").alias("at"), F.array_max("values").alias("value"))


def _within(values: Column, begin: Column, least: Column) -> Column:
    """The first place (from 0) from begin on whose value is at least `least`; null if there is none."""
    found = F.array_position(F.transform(F.slice(values, begin.cast("int") + 1, F.greatest(F.size(values) - begin.cast("int"), F.lit(0))), lambda x: F.coalesce(x >= least, F.lit(False))), True)
    return F.when(found > 0, begin + found - 1)


def first_reaching(rows: DataFrame, index: str, value: str, begin: Column, least: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with `name`: the smallest index from `begin` on whose value is at least `least`; null if there is none.

    index: 0, 1, 2 ... without gaps, each once; value may be null (reaches nothing). A null `least` finds nothing.
    """
    levels = _levels(rows, index, value, width)
    asked = rows.select(F.col(index).alias("_row"), begin.cast("long").alias("_at"), least.alias("_least")).where("_at is not null and _least is not null")
    found: list[DataFrame] = []
    for k, level in enumerate(levels):
        node = asked.withColumn("_node", F.floor(F.col("_at") / width).cast("long"))
        met = node.join(level, F.col("_node") == F.col("node")).withColumn("_place", _within(F.col("values"), F.col("_at") % width, F.col("_least")))
        met = kept(met.select("_row", "_least", "_node", (F.col("_node") * width + F.col("_place")).alias("_found")), "search")
        down = met.where("_found is not null").select("_row", "_least", "_found")
        for below in reversed(levels[:k]):
            into = down.join(below, F.col("_found") == F.col("node")).withColumn("_place", _within(F.col("values"), F.lit(0).cast("long"), F.col("_least")))
            down = into.select("_row", "_least", (F.col("node") * width + F.col("_place")).alias("_found"))
        found.append(down.select(F.col("_row").alias(index), F.col("_found").alias(name)))
        asked = met.where("_found is null").select("_row", (F.col("_node") + 1).alias("_at"), "_least")
    return rows.join(reduce(DataFrame.unionByName, found), index, "left")
