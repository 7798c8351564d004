"""Global transaction ids: high-water marks, intervals and their algebra.

A set is a DataFrame of server_uuid, s, e: closed intervals of transaction numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import with_previous, with_running
from millrace.plans.shared import kept

_HALF = 1 << 31
# Possessive: a server's text has any number of intervals, and what may be given back is kept on the stack.
_ONE = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?::[0-9]++(?:-[0-9]++)?+)++$"


def start_after(ops: DataFrame, marks: DataFrame) -> DataFrame:
    """Operations behind the marks (server_uuid, mark); servers without a mark pass whole."""
    return ops.join(marks, "server_uuid", "left").where(F.col("mark").isNull() | (F.col("trx_id") > F.col("mark"))).drop("mark")


def _reach(df: DataFrame, at: Column, of: DataFrame, name: str) -> DataFrame:
    """df (server_uuid, ...) with the largest end of the server's intervals in `of` that begin at or before `at`; null if none does.

    The end is carried along the numbers, bucket by bucket, so a server that sends everything, or has all the intervals, is no single task's.
    """
    both = df.withColumn("_k", 2 * at + 1).unionByName(of.select("server_uuid", (2 * F.col("s")).alias("_k"), F.col("e").alias("_e")), allowMissingColumns=True)
    return with_running(both, "_k", F.col("_e"), name, ["server_uuid"], "max").where("_e is null").drop("_k", "_e")


def excluding(ops: DataFrame, done: DataFrame) -> DataFrame:
    """Operations whose transaction is in none of the intervals of `done`. Those without server or number are in none."""
    numbers = ops.select("server_uuid", "trx_id").where("server_uuid is not null and trx_id is not null").distinct()
    inside = _reach(numbers, F.col("trx_id"), done, "_to").where("_to >= trx_id").select("server_uuid", "trx_id")
    return ops.join(inside, ["server_uuid", "trx_id"], "left_anti").select(*ops.columns)


def first_seen(trx: DataFrame) -> DataFrame:
    """Transactions (server_uuid, trx_id, pos) above all that their server has sent before."""
    seen = with_running(trx, "pos", F.col("trx_id"), "_mark", ["server_uuid"], "max", before=True)
    return seen.where(F.col("_mark").isNull() | (F.col("trx_id") > F.col("_mark"))).drop("_mark")


def gaps(trx: DataFrame) -> DataFrame:
    """server_uuid, missing_from, missing_to: numbers that are left out between two that are there."""
    known = trx.select("server_uuid", "trx_id").distinct()
    seen = with_previous(known, "trx_id", F.col("trx_id"), "_prev", ["server_uuid"])
    return seen.where(F.col("trx_id") - F.col("_prev") >= 2).select("server_uuid", (F.col("_prev") + 1).alias("missing_from"), (F.col("trx_id") - 1).alias("missing_to"))


def intervals(trx: DataFrame) -> DataFrame:
    """The set of the transactions that are there: adjacent numbers are one interval."""
    known = trx.select("server_uuid", "trx_id").distinct()
    seen = with_previous(known, "trx_id", F.col("trx_id"), "_prev", ["server_uuid"])
    opens = F.coalesce((F.col("trx_id") - F.col("_prev") > 1).cast("long"), F.lit(1).cast("long"))
    grouped = with_running(seen, "trx_id", opens, "_island", ["server_uuid"])
    return grouped.groupBy("server_uuid", "_island").agg(F.min("trx_id").alias("s"), F.max("trx_id").alias("e")).drop("_island")


def _covered(bounds: DataFrame, keep: Column) -> DataFrame:
    """Sweep over interval bounds (server_uuid, at, a, b: changes of how many cover from `at` on)."""
    steps = bounds.groupBy("server_uuid", "at").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b")).withColumn("_back", -F.col("at"))
    # Both counts in one running sum; neither is ever negative, for what ends has begun.
    spans = with_running(steps, "at", F.col("_a") * _HALF + F.col("_b"), "_both", ["server_uuid"])
    spans = with_previous(spans, "_back", F.col("at"), "_next", ["server_uuid"]).withColumns({"a": F.floor(F.col("_both") / _HALF), "b": F.col("_both") % _HALF})
    return joined(kept(spans.where(keep & F.col("_next").isNotNull()).select("server_uuid", F.col("at").alias("s"), (F.col("_next") - 1).alias("e")), "spans"))


def joined(parts: DataFrame) -> DataFrame:
    """Adjacent intervals of a disjoint set made one."""
    seen = with_previous(parts, "s", F.col("e"), "_before", ["server_uuid"])
    marked = with_running(seen, "s", (F.col("s") > F.coalesce("_before", F.lit(-2)) + 1).cast("long"), "_island", ["server_uuid"])
    return marked.groupBy("server_uuid", "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def _bounds(one: DataFrame, other: DataFrame) -> DataFrame:
    def ends(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select("server_uuid", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct((F.col("e") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))).alias("x")).select("server_uuid", "x.*")

    return ends(one, 1, 0).union(ends(other, 0, 1))


def union(one: DataFrame, other: DataFrame) -> DataFrame:
    return _covered(_bounds(one, other), (F.col("a") > 0) | (F.col("b") > 0))


def subtract(one: DataFrame, other: DataFrame) -> DataFrame:
    return _covered(_bounds(one, other), (F.col("a") > 0) & (F.col("b") <= 0))


def intersect(one: DataFrame, other: DataFrame) -> DataFrame:
    return _covered(_bounds(one, other), (F.col("a") > 0) & (F.col("b") > 0))


def contains(one: DataFrame, other: DataFrame) -> DataFrame:
    """server_uuid, contained: whether each interval of the other set lies inside one of ours."""
    inside = _reach(other.select("server_uuid", "s", "e"), F.col("s"), one, "_to")
    return inside.groupBy("server_uuid").agg(F.bool_and(F.coalesce(F.col("_to") >= F.col("e"), F.lit(False))).alias("contained"))


def high_water(trx: DataFrame) -> DataFrame:
    return trx.groupBy("server_uuid").agg(F.max("trx_id").alias("mark"))


def high_water_text(trx: DataFrame) -> DataFrame:
    """uuid:1-N for every server, sorted, comma-joined, in one row."""
    one = F.concat("server_uuid", F.lit(":1-"), F.col("mark").cast("string"))
    return high_water(trx).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("gtidset"))


def interval_text(of: DataFrame) -> DataFrame:
    """server_uuid, gtid: uuid:a-b:c, one row a server."""
    one = F.when(F.col("s") == F.col("e"), F.col("s").cast("string")).otherwise(F.concat_ws("-", F.col("s").cast("string"), F.col("e").cast("string")))
    each = of.groupBy("server_uuid").agg(F.array_sort(F.collect_list(F.struct("s", one.alias("x")))).alias("xs"))
    return each.select("server_uuid", F.concat("server_uuid", F.lit(":"), F.array_join("xs.x", ":")).alias("gtid"))


def parse(text: DataFrame, column: str = "gtid") -> DataFrame:
    """uuid:a-b:c texts, several comma-joined, as rows of their other columns, server_uuid, s, e, valid.

    A part that does not follow the form, or runs backwards, is one row with valid = false.
    """
    parts = text.select("*", F.explode(F.transform(F.split(column, ","), lambda x: F.trim(x))).alias("_part")).drop(column)
    valid = F.col("_part").rlike(_ONE)
    uuid = F.lower(F.substring_index("_part", ":", 1))
    ranges = F.when(valid, F.split(F.expr("substr(_part, 38)"), ":")).otherwise(F.array(F.lit("")))
    rows = parts.withColumn("_ok", valid).withColumn("server_uuid", F.when(valid, uuid)).withColumn("_r", F.explode(ranges))
    s, e = F.expr("try_cast(split_part(_r, '-', 1) as bigint)"), F.expr("try_cast(split_part(_r, '-', -1) as bigint)")
    rows = rows.withColumn("s", s).withColumn("e", e)
    return rows.withColumn("valid", F.col("_ok") & F.coalesce(F.col("s") <= F.col("e"), F.lit(False))).drop("_part", "_ok", "_r")


def parse_ranges(text: DataFrame, column: str = "gtid") -> DataFrame:
    """The strict form uuid:x-y, one interval a server, several comma-joined: other columns, server_uuid, mark (y), valid.
    A single number or a second interval is not valid here."""
    parts = text.select("*", F.explode(F.transform(F.split(column, ","), lambda x: F.trim(x))).alias("_part")).drop(column)
    valid = F.col("_part").rlike(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}:[0-9]{1,18}-[0-9]{1,18}$")
    return parts.withColumn("server_uuid", F.when(valid, F.lower(F.substring_index("_part", ":", 1)))).withColumn("mark", F.when(valid, F.expr("try_cast(substring_index(_part, '-', -1) as bigint)"))).withColumn("valid", valid).drop("_part")


def as_arrays(of: DataFrame) -> DataFrame:
    """server_uuid, intervals: a set's intervals in order, one row a server. Such rows compare as sets do: by
    server, then interval by interval; equal sets have equal rows."""
    return of.groupBy("server_uuid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("intervals"))


def same(one: DataFrame, other: DataFrame) -> DataFrame:
    """server_uuid, equal: whether both sets hold the same numbers of a server."""
    differing = subtract(one, other).union(subtract(other, one)).select("server_uuid").distinct().withColumn("_differs", F.lit(True))
    servers = one.select("server_uuid").union(other.select("server_uuid")).distinct()
    return servers.join(differing, "server_uuid", "left").select("server_uuid", F.col("_differs").isNull().alias("equal"))


def overlapping(one: DataFrame, other: DataFrame) -> DataFrame:
    """Intervals of one set that share a number with the other: those up to whose end one of the other's begins that ends at their start or behind it."""
    return _reach(one.select("server_uuid", "s", "e"), F.col("e"), other, "_to").where("_to >= s").select("server_uuid", "s", "e").distinct()


def _little_endian(n: Column) -> Column:
    h = F.lpad(F.hex(n), 16, "0")
    return F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))


def encoded(of: DataFrame) -> DataFrame:
    """One row, gtid_hex: the set in its binary form, as hex: servers, and for each its 16 bytes, how many intervals,
    and their first and one past their last number, all as eight little-endian bytes. An empty set is no server."""
    each = as_arrays(of).select("server_uuid", F.concat(F.replace("server_uuid", F.lit("-"), F.lit("")), _little_endian(F.size("intervals")), F.array_join(F.transform("intervals", lambda i: F.concat(_little_endian(i["s"]), _little_endian(i["e"] + 1))), "")).alias("x"))
    all_ = each.agg(F.array_sort(F.collect_list(F.struct("server_uuid", "x"))).alias("xs"))
    return all_.select(F.upper(F.concat(_little_endian(F.size("xs")), F.array_join("xs.x", ""))).alias("gtid_hex"))


def merge_min(sets: DataFrame, destinations: DataFrame) -> DataFrame:
    """server_uuid, mark from which every destination can go on; empty if one has nothing.

    sets: destination, server_uuid, mark; destinations: destination, all there are.
    """
    empty = destinations.join(sets, "destination", "left_anti").limit(1).select(F.lit(1).alias("_empty"))
    return sets.groupBy("server_uuid").agg(F.min("mark").alias("mark")).join(empty, F.lit(True), "left_anti")


def merge_max(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.union(other).groupBy("server_uuid").agg(F.max("mark").alias("mark"))


def start_marks(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Where a destination begins: what it stored, if that is anything, else what it is configured with."""
    some = stored.limit(1).select(F.lit(1).alias("_some"))
    return stored.unionByName(configured.join(some, F.lit(True), "left_anti"))
