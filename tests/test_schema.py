"""Versions of columns against a replay by hand; lists cut at commas outside quotes; rows carried to the last version."""

from millrace.operators import schema, statements

SAID = [
    (0, "CREATE TABLE t (id INT NOT NULL, `a,b` VARCHAR(9) DEFAULT 'it''s, (ok)', n DECIMAL(10,2) DEFAULT 1.5, PRIMARY KEY (id), UNIQUE KEY u (n), CONSTRAINT c CHECK (n > 0)) ENGINE=InnoDB COMMENT='x, y'"),
    (5, "ALTER TABLE t ADD COLUMN c1 INT FIRST, ADD c2 TEXT DEFAULT NULL AFTER `a,b`, ADD INDEX i (c1, c2)"),
    (9, "alter table t drop column n, rename column `a,b` to ab, add key k (ab)"),
    (12, "ALTER TABLE t CHANGE COLUMN c1 c9 BIGINT AFTER c2, MODIFY id BIGINT, DROP PRIMARY KEY, DROP missing"),
    (12, "ALTER TABLE other ADD x INT"),
    (20, "ALTER TABLE t MODIFY COLUMN c2 TEXT FIRST, ADD COLUMN n INT DEFAULT 3"),
]


def history(spark, said=SAID):
    df = spark.createDataFrame([(p, q, "s") for p, q in said], "pos long, query string, schema_ctx string")
    return schema.versions(schema.column_changes(statements.with_names(statements.classify(df))))


def test_versions(spark):
    got = {(r.tab, r.version): [(c.name, c.initial) for c in r["columns"]] for r in history(spark).collect()}
    assert got == {
        ("t", 0): [("id", None), ("a,b", "it's, (ok)"), ("n", "1.5")],
        ("t", 5): [("c1", None), ("id", None), ("a,b", "it's, (ok)"), ("c2", None), ("n", "1.5")],
        ("t", 9): [("c1", None), ("id", None), ("ab", "it's, (ok)"), ("c2", None)],
        ("t", 12): [("id", None), ("ab", "it's, (ok)"), ("c2", None), ("c9", None)],
        ("t", 20): [("c2", None), ("id", None), ("ab", "it's, (ok)"), ("c9", None), ("n", "3")],
        ("other", 12): [("x", None)],
    }


def test_rows_of_all_versions(spark):
    rows = [(1, ["1", "x", "2.5"]), (6, ["7", "2", None, "two", "8"]), (10, ["9", "3", "y", "three"]), (13, ["4", "z", "four", "11"]), (21, ["five", "5", "w"]), (0, ["no version yet"])]
    df = spark.createDataFrame([(p, "s", "t", v) for p, v in rows] + [(30, "s", "nowhere", ["1"])], "pos long, db string, tab string, image array<string>")
    got = {r.pos: r.image for r in schema.projected(df, history(spark)).collect()}
    assert got == {
        1: {"c2": None, "id": "1", "ab": "x", "c9": None, "n": "3"},  # the first n was dropped: the later one is another column
        6: {"c2": "two", "id": "2", "ab": None, "c9": "7", "n": "3"},
        10: {"c2": "three", "id": "3", "ab": "y", "c9": "9", "n": "3"},
        13: {"c2": "four", "id": "4", "ab": "z", "c9": "11", "n": "3"},
        21: {"c2": "five", "id": "5", "ab": "w", "c9": None, "n": None},
    }


def test_nothing(spark):
    df = spark.createDataFrame([], "pos long, db string, tab string, image array<string>")
    assert schema.projected(df, history(spark, [(1, "CREATE TABLE t (a INT)")])).collect() == []
    assert history(spark, [(1, "DROP TABLE t"), (2, None)]).collect() == []


def test_lists_are_cut_outside_quotes(spark):
    said = ["RENAME TABLE `a,b`.`c to d` TO `x.y`, e TO f.`g``h`", "DROP TABLE IF EXISTS `p.q`, r . s,`t , u` CASCADE", "DROP TABLE `one`"]
    df = spark.createDataFrame([(k, q, "ctx") for k, q in enumerate(said)], "pos long, query string, schema_ctx string")
    got = sorted((r.pos, r.part, r.db, r.tab, r.new_db, r.new_tab) for r in statements.with_names(statements.classify(df)).collect())
    assert got == [
        (0, 0, "a,b", "c to d", "ctx", "x.y"), (0, 1, "ctx", "e", "f", "g`h"),
        (1, 0, "ctx", "p.q", None, None), (1, 1, "r", "s", None, None), (1, 2, "ctx", "t , u", None, None), (2, 0, "ctx", "one", None, None),
    ]
