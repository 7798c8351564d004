"""Transaction ids of the form domain-server-sequence.

A domain is one order of transactions, whichever server sends them: its sequence grows along it, and a transaction
that a second server sends again has the domain and sequence that it had. A set is one mark a domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import with_previous, with_running

_FORM = r"^[0-9]{1,10}-[0-9]{1,10}-[0-9]{1,19}$"


def parse(text: DataFrame, column: str = "gtid") -> DataFrame:
    """Texts of ids, several comma-joined, as rows of their other columns, domain, server_id, seq, valid.

    domain and server_id have 32 bits, seq as many as a long; a part of another form, or beyond these, is one row with valid = false and no numbers.
    A null text gives no row.
    """
    parts = text.select("*", F.explode(F.transform(F.split(column, ","), lambda x: F.trim(x))).alias("_part")).drop(column)
    number = lambda k: F.split("_part", "-")[k].try_cast("long")
    valid = F.col("_part").rlike(_FORM) & F.coalesce((F.split_part("_part", F.lit("-"), F.lit(1)).try_cast("long") < 1 << 32) & (F.split_part("_part", F.lit("-"), F.lit(2)).try_cast("long") < 1 << 32) & F.split_part("_part", F.lit("-"), F.lit(3)).try_cast("long").isNotNull(), F.lit(False))
    return parts.withColumn("valid", valid).withColumns({name: F.when(F.col("valid"), number(k)) for k, name in enumerate(("domain", "server_id", "seq"))}).drop("_part")


def text(of: DataFrame) -> DataFrame:
    """One row, gtid: the marks (domain, server_id, seq) as text, by domain; empty for none."""
    one = F.concat_ws("-", *(F.col(c).cast("string") for c in ("domain", "server_id", "seq")))
    return of.agg(F.array_join(F.array_sort(F.collect_list(F.struct("domain", one.alias("x"))))["x"], ",").alias("gtid"))


def high_water(trx: DataFrame) -> DataFrame:
    """domain, server_id, seq: the highest of each domain, with the server that sent it (the smaller id, if two did)."""
    last = F.max(F.struct("seq", (-F.col("server_id")).alias("s")))
    return trx.groupBy("domain").agg(last.alias("_l")).select("domain", (-F.col("_l.s")).alias("server_id"), "_l.seq")


def start_after(ops: DataFrame, marks: DataFrame) -> DataFrame:
    """Operations behind the marks of their domains, of any server; domains without a mark pass whole."""
    own = marks.groupBy("domain").agg(F.max("seq").alias("_mark"))
    return ops.join(own, "domain", "left").where(F.col("_mark").isNull() | (F.col("seq") > F.col("_mark"))).drop("_mark")


def first_seen(trx: DataFrame) -> DataFrame:
    """Transactions (domain, server_id, seq, pos) above all that their domain has had before, from any server."""
    seen = with_running(trx, "pos", F.col("seq"), "_mark", ["domain"], "max", before=True)
    return seen.where(F.col("_mark").isNull() | (F.col("seq") > F.col("_mark"))).drop("_mark")


def gaps(trx: DataFrame) -> DataFrame:
    """domain, missing_from, missing_to: sequences that no server of the domain has sent, between two that are there."""
    seen = with_previous(trx.select("domain", "seq").distinct(), "seq", F.col("seq"), "_prev", ["domain"])
    return seen.where(F.col("seq") - F.col("_prev") >= 2).select("domain", (F.col("_prev") + 1).alias("missing_from"), (F.col("seq") - 1).alias("missing_to"))


def handovers(trx: DataFrame) -> DataFrame:
    """domain, pos, seq, from_server, to_server: where another server than before goes on with a domain's first transactions."""
    seen = with_previous(first_seen(trx), "pos", F.col("server_id"), "from_server", ["domain"])
    return seen.where(F.col("from_server") != F.col("server_id")).select("domain", "pos", "seq", "from_server", F.col("server_id").alias("to_server"))
