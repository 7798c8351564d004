"""Comparing tables: row by row, as bags, and as one number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.shared import kept


def by_key(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """key, status (missing, extra, differs) of the rows that are not the same in both."""
    rest = [c for c in source.columns if c not in key]
    a = source.select(*key, F.struct(*rest).alias("_a"))
    b = target.select(*key, F.struct(*rest).alias("_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(*key, status.alias("status")).where("status is not null")


def _node(key: list[str], bits: int) -> Column:
    """The node of a tree over hashes of keys that a row is under, at the depth of so many bits."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)


def under(df: DataFrame, nodes: DataFrame, key: list[str], bits: int) -> DataFrame:
    """The rows under the nodes (node) of this depth."""
    return df.withColumn("_node", _node(key, bits)).join(nodes.select(F.col("node").alias("_node")), "_node", "left_semi").drop("_node")


def differing_nodes(source: DataFrame, target: DataFrame, key: list[str], levels: tuple[int, ...] = (12, 10)) -> DataFrame | None:
    """node: the leaves of the tree whose rows are not the same in both; None if there are none.

    A node's checksum is how many rows it has and the sums of both halves of their hashes, so tables are summed where they are
    read and only sums are shuffled. A level of so many bits looks under the nodes that differed in the one above.
    """
    bits, nodes = 0, None

    def sums(df: DataFrame, sign: int) -> DataFrame:
        some = df if nodes is None else under(df, nodes, key, bits - step)
        # Hashes pass over nulls: which columns are null is hashed with them.
        h = F.xxhash64(*source.columns, *(F.col(c).isNull() for c in source.columns))
        each = some.select(_node(key, bits).alias("node"), h.alias("h"))
        halves = F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned("h", 32))
        return each.groupBy("node").agg(F.count("*").alias("n"), halves[0].alias("lo"), halves[1].alias("hi")).select("node", *((F.col(c) * sign).alias(c) for c in ("n", "lo", "hi")))

    for step in levels:
        bits += step
        both = sums(source, 1).unionByName(sums(target.select(*source.columns), -1)).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n", "lo", "hi")))
        nodes = kept(both.where("n <> 0 or lo <> 0 or hi <> 0").select("node"), "nodes")
        if nodes.isEmpty():
            return None
    return nodes


def by_key_tree(source: DataFrame, target: DataFrame, key: list[str], levels: tuple[int, ...] = (12, 10)) -> DataFrame:
    """by_key for tables that are nearly the same: only rows under leaves that differ are joined. Keys are distinct and not null.

    Tables are read once a level and once more; what a read shuffles are checksums, at last the rows of differing leaves.
    Two differing leaves pass for the same if their sums are, with a chance of about 2^-62.
    """
    nodes = differing_nodes(source, target, key, levels)
    if nodes is None:
        return by_key(source.limit(0), target.limit(0), key)
    return by_key(under(source, nodes, key, sum(levels)), under(target, nodes, key, sum(levels)), key)


def as_bags(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of which one side has more copies: the row, side, copies."""
    names = source.columns
    n = lambda side: F.count_if(F.col("_side") == side)
    both = source.withColumn("_side", F.lit("source")).unionByName(target.withColumn("_side", F.lit("target")))
    counted = both.groupBy(*names).agg((n("source") - n("target")).alias("_more")).where("_more <> 0")
    return counted.select(*names, F.when(F.col("_more") > 0, "source").otherwise("target").alias("side"), F.abs("_more").alias("copies"))


def row_hash(columns: list[Column]) -> Column:
    """32 bits of the row's MD5, nulls marked; the same in any engine that has MD5."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def table_hash(df: DataFrame, columns: list[Column]) -> DataFrame:
    """n_rows, hash: the same for the same rows in any order."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(row_hash(columns)).alias("hash"))


def same(source: DataFrame, target: DataFrame) -> bool:
    return as_bags(source, target).isEmpty()


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
