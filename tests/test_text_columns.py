"""Columns and values out of textual logs; positions of files."""

from millrace.operators import compare, fold
from millrace.operators.filters import after_position
from millrace.plans import catalog
from millrace.sources import binlog, oplog, textlog
from millrace.streaming import apply

HEAD = "#240520 12:34:57 server id 1  end_log_pos 205 CRC32 0x11111111 \t"
GTID = f"100\n{HEAD}GTID\tlast_committed=3\tsequence_number=4\nSET @@SESSION.GTID_NEXT= '01234567-89ab-cdef-0123-456789abcdef:5'/*!*/;"


def table_map(at, *columns):
    lines = "".join(("\n# Columns(" if k == 0 else ",\n#         ") + c for k, c in enumerate(columns)) + ")"
    return f"{at}\n{HEAD}Table_map: `d`.`t` mapped to number 108{lines if columns else ''}\n# Primary Key(id)"


def rows(at, *cells, verb="INSERT INTO", part="SET"):
    lines = "".join(f"\n###   @{k + 1}={c} /* meta */" for k, c in enumerate(cells))
    return f"{at}\n{HEAD}Write_rows: table id 108 flags: STMT_END_F\n### {verb} `d`.`t`\n### {part}{lines}"


def parsed(spark, *records):
    return textlog.parse(spark.createDataFrame([("log.000001", r) for r in records], "src_file string, record string"))


def sql(spark, *records):
    return [r.sql for r in textlog.statements(parsed(spark, *records)).orderBy("at", "part").collect()]


def test_columns_of_a_map(spark):
    got = parsed(spark, table_map(4, "`id` INT UNSIGNED NOT NULL", "`a``,b` ENUM('x,y','it''s',')') CHARSET utf8mb4", "`s` SET('p','q')", "`d` DECIMAL(10,2)", "`j` JSON")).first().columns
    assert [tuple(c) for c in got] == [("id", "INT"), ("a`,b", "ENUM('x,y','it''s',')')"), ("s", "SET('p','q')"), ("d", "DECIMAL(10,2)"), ("j", "JSON")]
    assert parsed(spark, table_map(4)).first().columns == []


def test_the_last_map_before_a_row_names_its_cells(spark):
    log = [rows(10, "1"), table_map(20, "`id` INT"), rows(30, "2", "3"), table_map(40, "`key` INT", "`v` TEXT"), rows(50, "4", "NULL"), rows(60, "5", "'NULL'", verb="DELETE FROM", part="WHERE"), rows(70, "6", "NULL", verb="DELETE FROM", part="WHERE")]
    assert sql(spark, *log) == [
        "INSERT INTO `d`.`t` SET `@1` = 1", "INSERT INTO `d`.`t` SET `id` = 2, `@2` = 3", "INSERT INTO `d`.`t` SET `key` = 4, `v` = NULL",
        "DELETE FROM `d`.`t` WHERE `key` = 5 AND `v` = 'NULL'", "DELETE FROM `d`.`t` WHERE `key` = 6 AND `v` IS NULL",
    ]


def test_cells_by_type(spark):
    columns = ["`e` ENUM('x,y','it''s')", "`s` SET('p','q''','r')", "`t` TIMESTAMP(3)", "`b` BIT(3)"]
    cells = lambda *cs: sql(spark, table_map(20, *columns), rows(30, *cs))[0].removeprefix("INSERT INTO `d`.`t` SET ")
    assert cells("2", "b'011'", "1700000000.500", "b'101'") == "`e` = 'it''s', `s` = 'p,q''', `t` = FROM_UNIXTIME(1700000000.500), `b` = b'101'"
    assert cells("0", "b'000'", "0", "NULL") == "`e` = '', `s` = '', `t` = FROM_UNIXTIME(0), `b` = NULL"
    assert cells("9", "NULL", "NULL", "b'0'") == "`e` = 9, `s` = NULL, `t` = NULL, `b` = b'0'"  # no such label


def test_values_and_transactions(spark):
    log = [GTID, table_map(120, "`id` BIGINT", "`v` VARCHAR(20)", "`t` TIMESTAMP"), rows(130, "7", r"'it''s \x27a\x0ab'", "12"), rows(140, "'x'", "NULL", verb="DELETE FROM", part="WHERE")]
    got = textlog.oplog(parsed(spark, *log), "v string, id long, t string, none string").orderBy("pos").collect()
    first, second = got
    assert tuple(first.after) == ("it's 'a\nb", 7, "12", None) and first.before is None
    assert (first.op, first.db, first.tab, first.trx_id, first.last_committed, first.gtid_pos) == ("insert", "d", "t", 5, 3, 100)
    assert tuple(second.before) == (None, None, None, None) and second.after is None and second.op == "delete"
    assert textlog.oplog(parsed(spark, rows(10, "1")), "id long").first().server_uuid is None
    assert textlog.oplog(parsed(spark, "no event"), "id long").count() == 0


def test_file_numbers_of_any_width(spark):
    at = spark.createDataFrame([("log.999999", 9), ("log.1000000", 5), ("log.999998", 5)], "src_file string, pos long")
    assert [r.src_file for r in after_position(at, "log.999999", 10).collect()] == ["log.1000000"]
    names = spark.createDataFrame([("a.000002.txt", 1, 1, 0), ("plain", 1, 1, 0)], "src_file string, pos long, gtid_pos long, row_idx int")
    assert sorted(r.pos for r in binlog.in_one_order(names).collect()) == [1, (2 << 40) + 1]


def test_files_of_a_stream_follow_the_log(spark, tmp_path):
    """More files than a batch takes: what a server sent first is in the first batch, whichever file was written first."""
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("event_id < 24000").write.parquet(f"{tmp_path}/events.parquet")
    want = fold.replace(oplog.read(spark, str(tmp_path))).select("db", "tab", "pk", "props")
    assert compare.same(catalog.stream_text(spark, str(tmp_path)), want)


def test_times_of_files_are_those_of_their_names(spark, tmp_path):
    for n in (3, 1, 2):
        (tmp_path / f"log.{n}").write_text("x")
    apply.in_order(spark, str(tmp_path))
    assert sorted(tmp_path.glob("log.*"), key=lambda f: f.stat().st_mtime) == [tmp_path / f"log.{n}" for n in (1, 2, 3)]


def test_rows_far_behind_their_map(spark):
    """Maps and transactions hold over the borders of stretches; bodies of rows meet them without a join of their own."""
    far = [k * textlog.WIDTH + 7 for k in range(6)]
    log = [GTID, table_map(120, "`id` BIGINT"), rows(far[1], "1"), rows(far[2], "2"), table_map(far[2] - 3, "`key` BIGINT"), rows(far[5], "3"), rows(10, "0"), table_map(far[5] + 1, "`late` BIGINT")]
    assert sql(spark, *log) == [f"INSERT INTO `d`.`t` SET `{c}` = {k}" for k, c in enumerate(("@1", "id", "key", "key"))]
    got = textlog.oplog(parsed(spark, *log), "id long, key long").orderBy("pos").collect()
    assert [(r.trx_id, r.gtid_pos, *r.after) for r in got] == [(None, None, None, None), (5, 100, 1, None), (5, 100, None, 2), (5, 100, None, 3)]
    plan = textlog.named(parsed(spark, *log))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_columns_by_map_are_joined_once(spark):
    """Rows are joined with what earlier stretches leave behind, and with nothing else."""
    plan = catalog.text_columns(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" in plan


def test_texts_are_made_and_parsed_once_in_all_tasks(spark):
    """Rows and what stretches leave behind come from one shuffle of parsed texts, and a table that one task reads is dealt before texts are made of it."""
    df = catalog.text_columns(spark, "/root/testdata/sf0.001")
    assert df.count() == 1000
    simple = spark.newSession()
    simple.conf.set("spark.sql.adaptive.enabled", "false")
    plan = catalog.text_columns(simple, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    made, read = plan.index("GTID\tlast_committed="), plan.index("FileScan parquet")
    assert "Exchange hashpartitioning(event_id" in plan[made:read] and "ReusedExchange" in plan and plan.count("FileScan parquet") == 1


def test_odd_blocks_and_heads(spark):
    """Several blocks of an event, marks inside values, white space before the event's name, an id of a later file."""
    many = f"30\n{HEAD}Update_rows: table id 108 flags: STMT_END_F\n### UPDATE `d`.`t`\n### WHERE\n###   @1=1\n### SET\n###   @1=2\n### INSERT INTO `d`.`t`\n### SET\n###   @1='a=@7=b'\n### DELETE FROM `d`.`t`\n### WHERE\n###   @1=3 /* INT */"
    odd = table_map(20, "`id` INT").replace("\tTable_map", "\n \x0bTable_map")
    assert sql(spark, odd, many) == ["UPDATE `d`.`t` SET `id` = 2 WHERE `id` = 1", "INSERT INTO `d`.`t` SET `id` = 'a=@7=b'", "DELETE FROM `d`.`t` WHERE `id` = 3"]
    assert sql(spark, f"30\n{HEAD}Write_rows: table id 108\n### no block", f"40\n{HEAD}Write_rows: table id 108") == []
    records = [("log.1", table_map(20, "`id` INT")), ("log.2", rows(30, "1")), ("log.1", rows(9, "2")), ("log.1", rows(2 * textlog.WIDTH, "3"))]
    got = textlog.statements(textlog.parse(spark.createDataFrame(records, "src_file string, record string"))).orderBy("src_file", "at").collect()
    assert [r.sql for r in got] == ["INSERT INTO `d`.`t` SET `@1` = 2", "INSERT INTO `d`.`t` SET `id` = 3", "INSERT INTO `d`.`t` SET `@1` = 1"]
