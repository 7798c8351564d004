"""Filters, statements and their quirks in compat mode."""

from pyspark.sql import functions as F

from millrace.operators.filters import Replicate, after_position, reader, replicate, replicate_statements
from millrace.operators.statements import change_sql, classify, with_names


def test_replicate_order_of_rules(spark):
    rows = [("mysql", "user"), ("shop", "a"), ("shop", "b"), ("other", "a"), (None, "a"), ("Shop", "a"), ("shop", None)]
    df = spark.createDataFrame(rows, "db string, tab string")
    take = lambda rule: [(r.db, r.tab) for r in replicate(df, rule).collect()]
    assert take(Replicate()) == [r for r in rows if r[0] != "mysql"]
    assert take(Replicate(do_db=("shop", "mysql"), ignore_table=("shop.b",))) == [("shop", "a"), ("shop", None)]
    assert take(Replicate(do_table=("shop.a",), ignore_db=("shop",))) == []


def test_statement_filter_and_compat(spark):
    df = spark.createDataFrame([("shop", "ddl_alter_table", "shop", "a"), ("", "ddl_alter_table", "shop", "a"), ("shop", "user_grant", "shop", ""), ("mysql", "user_grant", "mysql", "")], "schema_ctx string, kind string, db string, tab string")
    rule = Replicate(do_table=("shop.a",))
    assert replicate_statements(df, rule).count() == 3
    assert replicate_statements(df, rule, compat=True).count() == 0  # do_table turns all statements away there


def test_reader_only_wins(spark):
    df = spark.createDataFrame([("s", "a", "insert"), ("s", "b", "delete"), ("t", "a", "insert")], "db string, tab string, op string")
    assert reader(df, only_schemas=["s"], ignored_schemas=["s"]).count() == 2
    assert reader(df, ignored_tables=["a"]).count() == 1
    assert reader(df, ignored_ops=["insert"], only_tables=["b"]).count() == 1


def test_after_position(spark):
    df = spark.createDataFrame([("f1", 9), ("f2", 3), ("f2", 4), ("f3", 1)], "src_file string, pos long")
    assert after_position(df, "f2", 4).count() == 2


def test_classes_and_names(spark):
    said = {
        "create table if not exists `a b`.`t` (x int)": ("ddl_create_table", "a b", "t"),
        "ALTER TABLE t ADD c INT": ("ddl_alter_table", "ctx", "t"),
        "-- note\ndrop table x": ("ddl_drop_table", "ctx", "x"),
        "TRUNCATE t": ("ddl_truncate_table", "ctx", "t"),
        "create fulltext index i on d.t (c)": ("ddl_create_index", "d", "t"),
        "DROP INDEX i ON t": ("ddl_drop_index", "ctx", "t"),
        "create schema if not exists d": ("ddl_create_database", "d", ""),
        "ALTER USER u": ("user_alter", "ctx", ""),
        "optimize table t": ("unknown", "ctx", ""),
        "": ("unknown", "ctx", ""),
    }
    df = spark.createDataFrame([(q, "ctx") for q in said], "query string, schema_ctx string")
    got = {r.query: (r.kind, r.db, r.tab) for r in with_names(classify(df)).collect()}
    assert {q: got[q] for q in said} == said
    lists = spark.createDataFrame([("RENAME TABLE a TO b, x.c TO y.d", "ctx"), ("drop table a, `b`.`c` cascade", "ctx")], "query string, schema_ctx string")
    rows = sorted((r.sql for r in with_names(classify(lists)).collect()))
    assert rows == ["DROP TABLE IF EXISTS `b`.`c`", "DROP TABLE IF EXISTS `ctx`.`a`", "RENAME TABLE `ctx`.`a` TO `ctx`.`b`", "RENAME TABLE `x`.`c` TO `y`.`d`"]


def test_change_sql_modes(spark):
    df = spark.createDataFrame([(1, "d", "t", "insert", 5, 1.0, "p"), (2, "d", "t", "update", 5, 1.0, None)], "pos long, db string, tab string, op string, pk long, value double, props string")
    got = [r.sql for r in change_sql(df, insert="insert", update="replace").orderBy("pos").collect()]
    assert got[0].startswith("INSERT INTO `d`.`t`") and got[1].startswith("REPLACE INTO `d`.`t`")
    assert df.select(F.count("*")).first()[0] == 2
