"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a wished number of copies, target / size of its source. The whole part is taken;
the fractional part is a probability. Pivotal rounding pairs two such documents of a source and moves
probability from one to the other, in words, until one of them is 0 or 1: the expected words
stay what they were at every step. Blocks of documents are rounded apart; each leaves at most one open
document, and these are rounded again, block by block, up a tree until one is left per source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize, word_count

#: Share of all words that a mix takes; the most copies of a source; documents rounded in one task.
SHARE, MOST, BLOCK = 1.5, 2.0, 20_000
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wished of each source: `share` of all words, by weight; none above `most` times its
    size, the excess shared again among the others by weight until none is above."""
    size = np.array([n for _, n in sizes], float)
    weight, limit = np.array(weights, float), size * most
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    total = share * size.sum()
    while open_.any() and total > 0:
        give = np.where(open_, weight, 0) / weight[open_].sum() * total
        over = open_ & (give > limit)
        if not over.any():
            return list(np.where(open_, give, out))
        out[over] = limit[over]
        total -= limit[over].sum()
        open_ &= ~over
    return list(out)


def _pivot(rows: list[tuple], unit: np.random.Generator) -> list[tuple]:
    """rows: (key, size, p) with 0 < p < 1. Returns each with p in {0, 1}, but for at most one."""
    out: list[tuple] = []
    if not rows:
        return out
    a, size_a, p = rows[0]
    for (b, size_b, q), u in zip(rows[1:], unit.random(len(rows) - 1), strict=True):
        if not 0 < p < 1:  # both ended at once
            out.append((a, size_a, p))
            a, size_a, p = b, size_b, q
            continue
        up = min((1 - p) * size_a, q * size_b)  # words that can go from b to a
        down = min(p * size_a, (1 - q) * size_b)
        give = up if u * (up + down) < down else -down
        p2, q2 = p + give / size_a, q - give / size_b
        # The side that reached its end is exactly 0 or 1.
        ends_a = give == (1 - p) * size_a if give > 0 else -give == p * size_a
        if ends_a:
            out.append((a, size_a, 1.0 if give > 0 else 0.0))
            a, size_a, p = b, size_b, min(max(q2, 0.0), 1.0)
        else:
            out.append((b, size_b, 0.0 if give > 0 else 1.0))
            p = min(max(p2, 0.0), 1.0)
    out.append((a, size_a, p))
    return out


_KINDS = pa.schema([("row_id", pa.int64()), ("key", pa.int64()), ("source_no", pa.int32()), ("size", pa.int64()), ("p", pa.float64())])
_TYPES = "row_id long, key long, source_no int, size long, p double"


def _rounded(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        # Large ones first: what is open at the end is a small document, and so is the miss.
        rows = sorted(zip(table["key"].to_pylist(), table["row_id"].to_pylist(), table["size"].to_pylist(), table["p"].to_pylist(), strict=True), key=lambda r: (-r[2], r[0], r[3]))
        source = table["source_no"][0].as_py()
        unit = np.random.default_rng([seed, source, rows[0][0] & 0xFFFFFFFF, len(rows)])
        done = _pivot([((key, row), size, p) for key, row, size, p in rows], unit)
        if last and 0 < done[-1][2] < 1:
            key, size, p = done[-1]
            done[-1] = (key, size, float(unit.random() < p))
        return pa.Table.from_arrays([pa.array([d[0][1] for d in done]), pa.array([d[0][0] for d in done]), pa.array([source] * len(done), pa.int32()), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])], schema=_KINDS)

    return run


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with size, source_size, target (its source's) and copies, the times the mix takes it.

    Sources in code point order, a null source last, take the weights in turn. Sizes are words;
    documents without words (empty or null text) are taken as often as the whole part says and never
    rounded, for they add no words. The words taken of a source miss its target by less than one
    document. Rounding is decided by hashes of id and text, so a rerun agrees whatever the
    partitions; rows with the same id and text may swap their roles. A column of docs named as one of the four
    new ones is replaced; all others stay, whatever their names. An empty table gives an empty mix.
    """
    made = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in made]
    held = docs.select(F.struct(*keep).alias("doc"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    return mix_sized(held, **how).select(*(F.col("doc")[c].alias(c) for c in keep), *made)


def mix_sized(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """mix() for rows that have source, size and key, a hash that names the row, and at most a column doc besides.

    Only one row per source (its name and words) comes to the driver: sources are what weights are given to, so
    there are not more of them than a driver can hold. Documents stay in blocks of
    about `block` rows of one source, dealt by hash, so a source with a third of all rows is
    many blocks; so is a row that is repeated that often, for the repeats of such a key are dealt by row. Levels of the tree: log(documents) / log(block).
    """
    rows = materialize(docs.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    sums.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    wish = targets([(r["source"], r["n"]) for r in sums], [weights[k % len(weights)] for k in range(len(sums))], share, most)
    blocks = [max(1, -(-r["docs"] // block)) for r in sums]
    plan = docs.sparkSession.createDataFrame(
        [(k, r["source"], int(r["n"]), float(t), b) for k, (r, t, b) in enumerate(zip(sums, wish, blocks, strict=True))],
        "source_no int, name string, source_size long, target double, blocks long",
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wished = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumns({"base": F.floor(ratio), "p": ratio - F.floor(ratio)})
    narrow = wished.where("size > 0 and p > 0").select("row_id", "key", "source_no", "size", "p", "blocks")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(1, block // 4)).select("key", F.lit(True).alias("often"))
    dealt = F.pmod(F.xxhash64("key", F.lit(seed), F.when(F.col("often"), F.col("row_id")).otherwise(0)), F.col("blocks"))
    level = narrow.join(often, "key", "left").select("row_id", "key", "source_no", "size", "p", dealt.alias("block"))
    most_blocks, drawn = max([1, *blocks]), []
    while True:
        out = materialize(level.groupBy("source_no", "block").applyInArrow(_rounded(seed, most_blocks == 1), _TYPES), "pivotal")
        drawn.append(out.where("p = 0 or p = 1"))
        if most_blocks == 1:
            break
        most_blocks = -(-most_blocks // block)
        level = out.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("key", "row_id", F.lit(most_blocks)), F.lit(most_blocks)))
    ones = reduce(DataFrame.union, drawn).where("p = 1").select("row_id", F.lit(1).alias("one"))
    taken = wished.join(ones, "row_id", "left").withColumn("copies", (F.col("base") + F.coalesce("one", F.lit(0))).cast("long"))
    return taken.drop("one", "base", "p", "blocks", "name", "source_no")
