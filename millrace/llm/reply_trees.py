"""Chat formatting of reply trees.

Messages point at the message they answer. Iterative self-joins walk from the leaves to the roots, a
power of two a round; each leaf is a branch. Branches are ranked by score inside their tree, and each
chosen one is written as one conversation: turns marked by control strings, control strings inside
texts escaped so that they can be read back, and the code point spans that a loss mask covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

# The control strings of common chat templates, as what may follow their first character.
_OPEN = r"([<\[])(\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>))"
_SHUT = r"([<\[])\\(\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>))"
_TURN = r"(?s)<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n"


def escape(text: Column) -> Column:
    """Puts one backslash behind the first character of every control string."""
    return F.regexp_replace(text, _OPEN, r"$1\\$2")


def unescape(text: Column) -> Column:
    """Takes that backslash out again: unescape(escape(x)) is x for every x."""
    return F.regexp_replace(text, _SHUT, "$1$2")


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables of tree_id, msg_id, up: the ancestor 1, 2, 4, ... steps above, where there is one.

    Each is the self-join of the one before, so a tree of depth d takes log2(d) rounds. The last
    is empty, unless messages are their own ancestors: then it is what such cycles hold.
    """
    ids = messages.select("tree_id", F.col("msg_id").alias("up"))
    up = materialize(messages.where("parent_id is not null").select("tree_id", "msg_id", F.col("parent_id").alias("up")).distinct().join(ids.distinct(), ["tree_id", "up"], "left_semi").select("tree_id", "msg_id", "up"), "up")
    out, n = [up], up.count()
    while n:
        step = out[-1].select("tree_id", F.col("msg_id").alias("up"), F.col("up").alias("next"))
        above = materialize(out[-1].join(step, ["tree_id", "up"]).select("tree_id", "msg_id", F.col("next").alias("up")), "up")
        before, n = n, above.count()
        out.append(above)
        if n == before:  # in a forest each round loses some: these go round in cycles
            break
    return out


def branches(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths: tree_id, leaf_id, msg_id, steps (from the leaf), one row a message.

    messages: tree_id, msg_id (unique in its tree), parent_id (null: a root). A message that nothing answers is a leaf
    and ends a branch. Rounds of self-joins lengthen every branch at once: round k adds the ancestors 2^k
    steps above those found. Messages under a cycle or under a missing parent reach no root and are on no branch.
    """
    ups = ancestors(messages)
    loops = ups[-1].select("tree_id", "msg_id").distinct()
    asked = messages.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("msg_id")).distinct()
    leaves = messages.select("tree_id", "msg_id").join(asked, ["tree_id", "msg_id"], "left_anti").join(loops, ["tree_id", "msg_id"], "left_anti")
    found = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("long").alias("steps"))
    for k, up in enumerate(ups[:-1]):
        found = found.union(found.join(up, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", F.col("up").alias("msg_id"), (F.col("steps") + (1 << k)).alias("steps")))
        if k % 4 == 3:
            found = materialize(found, "branches")
    found = materialize(found, "branches")
    roots = messages.where("parent_id is null").select("tree_id", "msg_id")
    whole = found.join(roots, ["tree_id", "msg_id"], "left_semi").select("tree_id", "leaf_id")
    return found.join(whole, ["tree_id", "leaf_id"], "left_semi")


def chosen(paths: DataFrame, messages: DataFrame, keep: int = 1) -> DataFrame:
    """The messages of the `keep` best branches of each tree (highest summed score, then longest, then
    smallest leaf id): tree_id, leaf_id, rank, at, role, text; null scores count 0.

    Branches are ranked by their scores alone; texts are joined to the chosen ones only.
    """
    scores = messages.select("tree_id", "msg_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    sums = paths.join(scores, ["tree_id", "msg_id"]).groupBy("tree_id", "leaf_id").agg(F.sum("score").alias("total"), F.max("steps").alias("depth"))
    best = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "leaf_id")
    kept = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("tree_id", "leaf_id", "rank", "depth")
    said = paths.join(kept, ["tree_id", "leaf_id"]).join(messages.select("tree_id", "msg_id", "role", "text"), ["tree_id", "msg_id"])
    return said.select("tree_id", "leaf_id", "rank", (F.col("depth") - F.col("steps")).alias("at"), "role", "text")


def escape_role(role: Column) -> Column:
    """A role on one line: backslashes and line ends as backslash and letter, then control strings as in texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """unescape_role(escape_role(x)) is x for every x: no backslash but those of the two pairs is left in between."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def conversation(turns: DataFrame) -> DataFrame:
    """One row a conversation from rows of conv_id, at, role, text: conv_id, n_turns, formatted, loss.

    loss: the (start, length) spans, in code points from 1, of the assistants' escaped texts.
    A null role is written as unknown, a null text as the empty text; rows with one `at` go by role and
    text. Other columns are dropped. Line ends, backslashes and control strings in roles are escaped
    too. A conversation is one value, so it has to fit in a task's memory.
    """
    role = escape_role(F.coalesce(F.col("role"), F.lit("unknown")))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select("conv_id", "at", role.alias("role"), body.alias("body"))
    before = Window.partitionBy("conv_id").orderBy("at", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    written = F.coalesce(F.sum(17 + F.length("role") + F.length("body")).over(before), F.lit(0))
    rows = rows.withColumn("start", (written + 10 + F.length("role")).cast("long"))
    turn = F.struct("at", "role", "body", "start")
    all_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lines = F.transform("turns", lambda x: F.concat(F.lit("<|turn|>"), x.role, F.lit("\n"), x.body, F.lit("<|end|>\n")))
    spans = F.transform(F.filter("turns", lambda x: x.role == "assistant"), lambda x: F.struct(x.start.alias("start"), F.length(x.body).cast("long").alias("length")))
    return all_.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(lines, "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What conversation() wrote, read from its output alone: turns array<struct<role,text>> and
    loss_text, the unescaped text under the loss mask. Each span is counted off from the start, so the
    cost of one conversation is its length times its assistant turns."""
    turns = F.transform(
        F.regexp_extract_all("formatted", F.lit(f"({_TURN})"), 1),
        lambda x: F.struct(unescape_role(F.regexp_extract(x, _TURN, 1)).alias("role"), unescape(F.regexp_extract(x, _TURN, 2)).alias("text")),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def digests(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Formats the chosen branches of messages (tree_id, msg_id, parent_id, role, text, score) and
    returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    messages = materialize(messages, "messages")
    best = chosen(branches(messages.drop("role", "text")), messages, keep)
    turns = best.select(F.struct("tree_id", "rank").alias("conv_id"), "at", "role", "text")
    read = read_back(conversation(turns)).withColumn("conv_id", F.col("conv_id.tree_id"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_tree(rows: DataFrame) -> DataFrame:
    """A table of conv_id, turn, role, text as messages: each row answers the one before it.

    Rows with the same turn (repeated rows) follow each other, by role and text, nulls first. tree_id is
    (whether conv_id is null, conv_id or 0): a null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"))
    rows = rows.select(tree.alias("tree_id"), F.row_number().over(order).cast("long").alias("msg_id"), "role", "text")
    return rows.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
