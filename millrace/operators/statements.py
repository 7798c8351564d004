"""Statements in the log: what they are, which tables they touch, and changes as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"(?:`(?:[^`]|``)+`|[A-Za-z0-9_$]+)"
TABLE = rf"{NAME}(?:\s*\.\s*{NAME})?"
_QUOTED = r"`(?:[^`]|``)*`|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\""
#: One item of a list: up to a comma that stands outside quotes and parentheses.
ITEM = rf"(?s)(?:{_QUOTED}|\((?:{_QUOTED}|\((?:{_QUOTED}|[^()'`\"])*\)|[^()'`\"])*\)|[^,`'\"(])+"
#: What separates the two names of a rename, and of a qualified name, behind the first of them.
_FIRST_OF_TWO = rf"(?is)^({TABLE})\s+to\s+({TABLE})$"
_QUALIFIED = rf"(?s)^({NAME})\s*\.\s*({NAME})$"
# A statement's kind and pattern; its group is the (first) table, or the list of tables.
KINDS = (
    ("begin", r"(?i)^begin\b()"),
    ("commit", r"(?i)^commit\b()"),
    ("ddl_rename_table", rf"(?is)^rename\s+tables?\s+(.+)$"),
    ("ddl_drop_table", r"(?is)^drop\s+table\s+(?:if\s+exists\s+)?(.+?)(?:\s+(?:restrict|cascade))?$"),
    ("ddl_create_table", rf"(?is)^create\s+(?:temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?({TABLE})"),
    ("ddl_alter_table", rf"(?is)^alter\s+table\s+({TABLE})"),
    ("ddl_truncate_table", rf"(?is)^truncate\s+(?:table\s+)?({TABLE})"),
    ("ddl_create_index", rf"(?is)^create\s+(?:unique\s+|fulltext\s+|spatial\s+)?index\s+{NAME}\s+(?:using\s+\w+\s+)?on\s+({TABLE})"),
    ("ddl_drop_index", rf"(?is)^drop\s+index\s+{NAME}\s+on\s+({TABLE})"),
    ("ddl_create_database", rf"(?is)^create\s+(?:database|schema)\s+(?:if\s+not\s+exists\s+)?({NAME})"),
    ("ddl_alter_database", rf"(?is)^alter\s+(?:database|schema)\s+({NAME})"),
    ("ddl_drop_database", rf"(?is)^drop\s+(?:database|schema)\s+(?:if\s+exists\s+)?({NAME})"),
    ("user_create", r"(?is)^create\s+user\b()"),
    ("user_drop", r"(?is)^drop\s+user\b()"),
    ("user_alter", r"(?is)^alter\s+user\b()"),
    ("user_grant", r"(?is)^grant\b()"),
    ("user_revoke", r"(?is)^revoke\b()"),
)


def bare(query: Column) -> Column:
    """Without comments, outer white space and the closing semicolon."""
    return F.regexp_replace(F.regexp_replace(query, r"(?s)/\*.*?\*/|(?m)^--[^\n]*$", " "), r"^\s+|[\s;]+$", "")


def unquoted(name: Column) -> Column:
    """A name without its back-ticks; doubled ones inside are one."""
    trimmed = F.trim(name)
    inside = F.regexp_replace(F.regexp_extract(trimmed, r"(?s)^`(.*)`$", 1), "``", "`")
    return F.when(trimmed.rlike(r"(?s)^`.*`$"), inside).otherwise(trimmed)


def list_items(text: Column) -> Column:
    """The items of a list, cut at commas outside quotes, back-ticks and parentheses (two levels deep), without outer white space."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(ITEM), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def classify(statements: DataFrame, query: str = "query") -> DataFrame:
    """statements with kind ('unknown' for what no pattern knows, reported rather than dropped) and
    target, the text that names the table, tables or database."""
    text = bare(F.col(query))
    kind, target = F.lit("unknown"), F.lit("")
    for name, pattern in reversed(KINDS):
        hit = text.rlike(pattern)
        kind, target = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(target)
    return statements.withColumn("kind", kind).withColumn("target", target)


def with_names(classified: DataFrame, context: str = "schema_ctx") -> DataFrame:
    """One row per table: db (its own qualifier, else the schema the statement ran in), tab, new_db and
    new_tab (of a rename), part (its place in the list) and a statement of its own for each."""
    pairs = F.when(F.col("kind").isin("ddl_rename_table", "ddl_drop_table"), list_items(F.col("target"))).otherwise(F.array("target"))
    rows = classified.select("*", F.posexplode(pairs).alias("part", "_one"))
    two = (F.col("kind") == "ddl_rename_table") & F.col("_one").rlike(_FIRST_OF_TWO)
    rows = rows.withColumn("_from", F.when(two, F.regexp_extract("_one", _FIRST_OF_TWO, 1)).otherwise(F.trim("_one"))).withColumn("_to", F.when(two, F.regexp_extract("_one", _FIRST_OF_TWO, 2)))

    def db(name: str) -> Column:
        return F.when(F.col(name).rlike(_QUALIFIED), unquoted(F.regexp_extract(name, _QUALIFIED, 1))).otherwise(F.col(context))

    def tab(name: str) -> Column:
        return unquoted(F.when(F.col(name).rlike(_QUALIFIED), F.regexp_extract(name, _QUALIFIED, 2)).otherwise(F.col(name)))

    of_db = F.col("kind").endswith("database")
    no_table = F.col("kind").startswith("user") | F.col("kind").isin("begin", "commit", "unknown")
    rows = rows.withColumn("db", F.when(of_db, unquoted(F.col("_from"))).otherwise(db("_from"))).withColumn("tab", F.when(of_db | no_table, "").otherwise(tab("_from")))
    rows = rows.withColumn("new_db", F.when(F.col("_to").isNotNull(), db("_to"))).withColumn("new_tab", F.when(F.col("_to").isNotNull(), tab("_to")))
    sql = (
        F.when(F.col("kind") == "ddl_drop_table", F.format_string("DROP TABLE IF EXISTS `%s`.`%s`", "db", "tab"))
        .when(F.col("kind") == "ddl_rename_table", F.format_string("RENAME TABLE `%s`.`%s` TO `%s`.`%s`", "db", "tab", "new_db", "new_tab"))
        .otherwise(F.col("query"))
    )
    return rows.withColumn("part", F.col("part").cast("long")).withColumn("sql", sql).drop("_one", "_from", "_to")


def change_sql(ops: DataFrame, insert: str = "replace", update: str = "update") -> DataFrame:
    """pos, sql, params: each change as a statement with placeholders. insert: replace or insert;
    update: update (by key) or replace."""
    name = F.format_string("`%s`.`%s`", "db", "tab")
    put = F.concat(F.lit("REPLACE INTO "), name, F.lit(" (`pk`, `value`, `props`) VALUES (?, ?, ?)"))
    new = put if insert == "replace" else F.concat(F.lit("INSERT INTO "), name, F.lit(" (`pk`, `value`, `props`) VALUES (?, ?, ?)"))
    change = put if update == "replace" else F.concat(F.lit("UPDATE "), name, F.lit(" SET `pk` = ?, `value` = ?, `props` = ? WHERE `pk` = ?"))
    gone = F.concat(F.lit("DELETE FROM "), name, F.lit(" WHERE `pk` = ?"))
    key, row = F.col("pk").cast("string"), F.to_json(F.struct("pk", "props"))
    return ops.select(
        "pos", F.when(F.col("op") == "insert", new).when(F.col("op") == "update", change).otherwise(gone).alias("sql"),
        F.when(F.col("op") == "delete", key).otherwise(row).alias("params"),
    )
