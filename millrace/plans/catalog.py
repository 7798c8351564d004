"""The queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values
from millrace.operators import compare, domain_ids, filters, fold, gtid, metrics, schema, statements, transactions
from millrace.plans.shared import fresh_folder
from millrace.sources import binlog, binlog_writer, oplog, textlog
from millrace.streaming import apply, group_log, leveled, log_fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_OPS = """ops AS (
  SELECT event_id AS pos, ts, CAST(floor(event_id / 4.0) AS BIGINT) AS trx_no,
    '0000000' || CAST(CAST(floor(event_id / 4.0) AS BIGINT) % 3 AS VARCHAR) || '-0000-4000-8000-000000000000' AS server_uuid,
    CAST(floor(CAST(floor(event_id / 4.0) AS BIGINT) / 3.0) AS BIGINT) + 1 AS trx_id,
    CAST(floor(CAST(floor(event_id / 4.0) AS BIGINT) / 5.0) AS BIGINT) * 5 AS last_committed,
    CASE WHEN user_id % 10 = 9 THEN 'mysql' WHEN user_id % 10 = 8 THEN 'audit' ELSE 'shop' END AS db,
    CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'carts' END AS tab,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    user_id AS pk, value, props
  FROM events
), trx AS (
  SELECT trx_no, server_uuid, trx_id, last_committed, min(pos) AS pos, count(*) AS n_ops FROM ops GROUP BY ALL
)"""


def query(sql: str | None = None):
    """Registers a query under its function's name; {ops} in its SQL stands for the operation log."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{ops}", _OPS)
        return f

    return put


def _trx(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.transactions(oplog.read(spark, folder))


# -- scans and filters -----------------------------------------------------------------------------


@query("WITH {ops} SELECT pos, coalesce(lag(pos) OVER (ORDER BY pos), 4) AS start_pos, op, db, tab FROM ops")
def oplog_scan(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.plans.ordered import with_previous

    seen = with_previous(oplog.read(spark, folder).select("pos", "op", "db", "tab"), "pos", F.col("pos"), "start_pos")
    return seen.withColumn("start_pos", F.coalesce("start_pos", F.lit(4)))


RULE = filters.Replicate(do_db=("shop", "audit"), ignore_db=("archive",), ignore_table=("audit.users",))


@query("WITH {ops} SELECT pos, db, tab, op FROM ops WHERE db || '.' || tab <> 'audit.users' AND db NOT IN ('mysql', 'archive') AND db IN ('shop', 'audit')")
def replicate_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.replicate(oplog.read(spark, folder), RULE).select("pos", "db", "tab", "op")


@query("WITH {ops} SELECT pos, db, tab, op FROM ops WHERE db = 'shop' AND tab <> 'users' AND op IN ('insert', 'delete')")
def reader_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.reader(oplog.read(spark, folder), only_schemas=("shop",), ignored_schemas=("shop",), ignored_tables=("users",), only_ops=("insert", "delete"))
    return kept.select("pos", "db", "tab", "op")


@query("SELECT event_id AS pos, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def skip_to_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    raw = oplog.table(spark, folder, "events")
    return filters.from_timestamp(raw, datetime(2024, 1, 15)).select(F.col("event_id").alias("pos"), "event_type")


@query("WITH {ops}, s AS (SELECT pos, op, coalesce(lag(pos) OVER (ORDER BY pos), 4) AS start_pos FROM ops) SELECT pos, op, start_pos FROM s WHERE start_pos < 5000")
def end_log_pos(spark: SparkSession, folder: str) -> DataFrame:
    return filters.up_to_position(oplog_scan(spark, folder).select("pos", "op", "start_pos"), 5000)


# -- statements ------------------------------------------------------------------------------------

_STATEMENTS = (
    "CREATE TABLE IF NOT EXISTS `shop`.`t1` (id INT)", "create table t2 (id int)", "ALTER TABLE shop.users ADD COLUMN c INT", "DROP TABLE IF EXISTS a, `b`.`c`",
    "RENAME TABLE a TO b, shop.c TO shop.d", "TRUNCATE TABLE users", "CREATE UNIQUE INDEX i1 ON shop.carts (k)", "DROP INDEX i1 ON carts",
    "CREATE DATABASE IF NOT EXISTS audit", "ALTER DATABASE `audit` CHARACTER SET utf8mb4", "drop schema audit", "CREATE USER u IDENTIFIED BY x",
    "GRANT SELECT ON shop.* TO u", "REVOKE SELECT ON shop.* FROM u", "BEGIN", "/* a hint */ ALTER TABLE `mysql`.`users` DROP c;", "FLUSH PRIVILEGES", "COMMIT",
)


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """A log of statements: which one, and in which schema, by the position of an event."""
    events = oplog.table(spark, folder, "events")
    context = F.when(F.col("user_id") % 3 == 0, "mysql").when(F.col("user_id") % 3 == 1, "shop").otherwise("")
    text = F.get(F.array(*map(F.lit, _STATEMENTS)), (F.col("event_id") % len(_STATEMENTS)).cast("int"))
    return events.select(F.col("event_id").alias("pos"), context.alias("schema_ctx"), text.alias("query"))


_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in _STATEMENTS) + "]"
_N = statements.NAME.replace("(?:", "(?:")
_STMT = (
    f"""st AS (
  SELECT event_id AS pos, CASE user_id % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'shop' ELSE '' END AS schema_ctx,
    list_extract({_LIST}, CAST(event_id % {len(_STATEMENTS)} AS INTEGER) + 1) AS query FROM events
), b AS (
  SELECT *, regexp_replace(regexp_replace(query, '(?s)/\\*.*?\\*/', ' ', 'g'), '^\\s+|[\\s;]+$', '', 'g') AS t FROM st
), k AS (
  SELECT pos, schema_ctx, query, CASE """
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in statements.KINDS)
    + " ELSE 'unknown' END AS kind, CASE "
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 1)" for n, p in statements.KINDS)
    + r""" ELSE '' END AS target FROM b
), p AS (
  SELECT *, CASE WHEN kind IN ('ddl_rename_table', 'ddl_drop_table') THEN string_split_regex(target, '\s*,\s*') ELSE [target] END AS parts FROM k
), o AS (
  SELECT *, CAST(unnest(range(0, len(parts))) AS BIGINT) AS part, unnest(parts) AS one FROM p
), f AS (
  SELECT *, trim(CASE WHEN kind = 'ddl_rename_table' THEN string_split_regex(one, '(?i)\s+to\s+')[1] ELSE one END) AS f1,
    CASE WHEN kind = 'ddl_rename_table' THEN trim(string_split_regex(one, '(?i)\s+to\s+')[2]) END AS f2 FROM o
), named AS (
  SELECT pos, schema_ctx, query, kind, part,
    CASE WHEN kind LIKE '%database' THEN replace(f1, '`', '') WHEN f1 LIKE '%.%' THEN replace(split_part(f1, '.', 1), '`', '') ELSE schema_ctx END AS db,
    CASE WHEN kind LIKE '%database' OR kind LIKE 'user%' OR kind IN ('begin', 'commit', 'unknown') THEN '' ELSE replace(split_part(f1, '.', -1), '`', '') END AS tab,
    CASE WHEN f2 LIKE '%.%' THEN replace(split_part(f2, '.', 1), '`', '') WHEN f2 IS NOT NULL THEN schema_ctx END AS new_db,
    CASE WHEN f2 IS NOT NULL THEN replace(split_part(f2, '.', -1), '`', '') END AS new_tab FROM f
)"""
)


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return statements.with_names(statements.classify(_statements(spark, folder)))


@query(f"WITH {_STMT} SELECT pos, kind, target FROM k")
def ddl_classify(spark: SparkSession, folder: str) -> DataFrame:
    return statements.classify(_statements(spark, folder)).select("pos", "kind", "target")


@query(f"""WITH {_STMT} SELECT pos, part, db, tab, new_db, new_tab,
  CASE kind WHEN 'ddl_drop_table' THEN 'DROP TABLE IF EXISTS `' || db || '`.`' || tab || '`' ELSE 'RENAME TABLE `' || db || '`.`' || tab || '` TO `' || new_db || '`.`' || new_tab || '`' END AS sql
  FROM named WHERE kind IN ('ddl_drop_table', 'ddl_rename_table')""")
def ddl_explode_rename_drop(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).where(F.col("kind").isin("ddl_drop_table", "ddl_rename_table")).select("pos", "part", "db", "tab", "new_db", "new_tab", "sql")


@query(f"WITH {_STMT} SELECT pos, part, kind, db, tab FROM named WHERE kind LIKE 'ddl%'")
def default_schema(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).where("kind like 'ddl%'").select("pos", "part", "kind", "db", "tab")


@query(f"""WITH {_STMT} SELECT pos, part, kind, db, tab FROM named WHERE CASE WHEN kind LIKE 'user%' THEN schema_ctx NOT IN ('mysql', 'archive') AND schema_ctx IN ('shop', 'audit')
  ELSE db NOT IN ('mysql', 'archive') AND db || '.' || tab <> 'audit.users' AND db IN ('shop', 'audit') END""")
def ddl_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.replicate_statements(_named(spark, folder), RULE).select("pos", "part", "kind", "db", "tab")


@query(f"""WITH {_STMT} SELECT db, tab, count(*) FILTER (kind LIKE '%database' AND db <> 'mysql') AS ddl_database_total, count(*) FILTER (kind LIKE '%database' AND db = 'mysql') AS ddl_database_skip_total,
  count(*) FILTER (kind NOT LIKE '%database' AND db <> 'mysql') AS ddl_table_total, count(*) FILTER (kind NOT LIKE '%database' AND db = 'mysql') AS ddl_table_skip_total FROM named WHERE kind LIKE 'ddl%' GROUP BY db, tab""")
def ddl_counters(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.statement_counters(_named(spark, folder), F.col("db") != "mysql")


@query("""WITH {ops} SELECT pos, CASE op WHEN 'insert' THEN 'REPLACE INTO `' || db || '`.`' || tab || '` (`pk`, `value`, `props`) VALUES (?, ?, ?)'
  WHEN 'update' THEN 'UPDATE `' || db || '`.`' || tab || '` SET `pk` = ?, `value` = ?, `props` = ? WHERE `pk` = ?' ELSE 'DELETE FROM `' || db || '`.`' || tab || '` WHERE `pk` = ?' END AS sql,
  CASE op WHEN 'delete' THEN CAST(pk AS VARCHAR) ELSE '{"pk":' || CAST(pk AS VARCHAR) || ',"props":' || CAST(to_json(props) AS VARCHAR) || '}' END AS params FROM ops""")
def dml_sql_text(spark: SparkSession, folder: str) -> DataFrame:
    return statements.change_sql(oplog.read(spark, folder))


# -- transaction ids -------------------------------------------------------------------------------

_U = "0000000{}-0000-4000-8000-000000000000"


def _marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(_U.format(0), 100), (_U.format(1), 30)], "server_uuid string, mark long")


_MARKS = f"marks(server_uuid, mark) AS (VALUES ('{_U.format(0)}', 100), ('{_U.format(1)}', 30))"


@query("WITH {ops}, " + _MARKS + " SELECT pos, server_uuid, trx_id FROM ops LEFT JOIN marks USING (server_uuid) WHERE mark IS NULL OR trx_id > mark")
def start_after_gtid(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.start_after(oplog.read(spark, folder), _marks(spark)).select("pos", "server_uuid", "trx_id")


_DONE = [(0, 1, 50), (0, 60, 60), (1, 10, 400), (2, 5, 5)]


@query("WITH {ops}, done(u, s, e) AS (VALUES " + ", ".join(f"('{_U.format(u)}', {s}, {e})" for u, s, e in _DONE) + ") SELECT pos, server_uuid, trx_id FROM ops ANTI JOIN done ON server_uuid = u AND trx_id BETWEEN s AND e")
def exclude_gtids(spark: SparkSession, folder: str) -> DataFrame:
    done = spark.createDataFrame([(_U.format(u), s, e) for u, s, e in _DONE], "server_uuid string, s long, e long")
    return gtid.excluding(oplog.read(spark, folder), done).select("pos", "server_uuid", "trx_id")


@query("""WITH {ops}, twice AS (SELECT * FROM trx UNION ALL SELECT * REPLACE (pos + 100000000 AS pos) FROM trx WHERE trx_no % 7 < 3),
  m AS (SELECT *, max(trx_id) OVER (PARTITION BY server_uuid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM twice)
  SELECT pos, server_uuid, trx_id FROM m WHERE h IS NULL OR trx_id > h""")
def gtid_dedup(spark: SparkSession, folder: str) -> DataFrame:
    trx = _trx(spark, folder)
    again = trx.where("trx_no % 7 < 3").withColumn("pos", F.col("pos") + 100_000_000)
    return gtid.first_seen(trx.unionByName(again)).select("pos", "server_uuid", "trx_id")


def _holed(spark: SparkSession, folder: str) -> DataFrame:
    return _trx(spark, folder).where("trx_id % 17 <> 0 and trx_id % 23 > 1")


_HOLED = "WITH {ops}, holed AS (SELECT DISTINCT server_uuid, trx_id FROM trx WHERE trx_id % 17 <> 0 AND trx_id % 23 > 1)"
_ISLANDS = _HOLED + ", islands AS (SELECT server_uuid, min(trx_id) AS s, max(trx_id) AS e FROM (SELECT *, trx_id - row_number() OVER (PARTITION BY server_uuid ORDER BY trx_id) AS g FROM holed) GROUP BY server_uuid, g)"


@query(_HOLED + ", l AS (SELECT *, lag(trx_id) OVER (PARTITION BY server_uuid ORDER BY trx_id) AS p FROM holed) SELECT server_uuid, p + 1 AS missing_from, trx_id - 1 AS missing_to FROM l WHERE trx_id - p >= 2")
def gtid_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.gaps(_holed(spark, folder))


@query(_ISLANDS + " SELECT server_uuid, s, e FROM islands")
def gtid_islands(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.intervals(_holed(spark, folder))


@query("WITH {ops} SELECT string_agg(server_uuid || ':1-' || m, ',' ORDER BY server_uuid) AS gtidset FROM (SELECT server_uuid, max(trx_id) AS m FROM trx GROUP BY server_uuid)")
def gtidset_highwater(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.high_water_text(_trx(spark, folder))


@query("""WITH {ops} SELECT server_uuid, min(m) AS mark FROM (SELECT server_uuid, trx_no % 4 AS d, max(trx_id) AS m FROM trx GROUP BY ALL) GROUP BY server_uuid""")
def gtidset_min_merge(spark: SparkSession, folder: str) -> DataFrame:
    sets = _trx(spark, folder).groupBy((F.col("trx_no") % 4).alias("destination"), "server_uuid").agg(F.max("trx_id").alias("mark"))
    return gtid.merge_min(sets, spark.range(4).select(F.col("id").alias("destination")))


@query("WITH {ops}, " + _MARKS + " SELECT server_uuid, max(m) AS mark FROM (SELECT server_uuid, trx_id % 200 AS m FROM trx UNION ALL SELECT * FROM marks) GROUP BY server_uuid")
def gtidset_max_merge(spark: SparkSession, folder: str) -> DataFrame:
    stored = gtid.high_water(_trx(spark, folder).withColumn("trx_id", F.col("trx_id") % 200))
    return gtid.merge_max(stored, _marks(spark))


_NUMBERS = ", islands_of AS (SELECT server_uuid, min(n) AS s, max(n) AS e FROM (SELECT *, n - row_number() OVER (PARTITION BY server_uuid ORDER BY n) AS g FROM picked) GROUP BY server_uuid, g) SELECT server_uuid, s, e FROM islands_of"


def _done(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(_U.format(u), s, e) for u, s, e in _DONE], "server_uuid string, s long, e long")


_DONE_N = ", done AS (SELECT u AS server_uuid, unnest(range(s, e + 1)) AS n FROM (VALUES " + ", ".join(f"('{_U.format(u)}', {s}, {e})" for u, s, e in _DONE) + ") AS v(u, s, e))"


@query(_HOLED + _DONE_N + ", picked AS (SELECT server_uuid, trx_id AS n FROM holed EXCEPT SELECT server_uuid, n FROM done)" + _NUMBERS)
def gtid_subtract(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.subtract(gtid.intervals(_holed(spark, folder)), _done(spark))


@query(_HOLED + _DONE_N + ", picked AS (SELECT server_uuid, trx_id AS n FROM holed UNION SELECT server_uuid, n FROM done)" + _NUMBERS)
def gtid_union(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.union(gtid.intervals(_holed(spark, folder)), _done(spark))


@query(_HOLED + _DONE_N + ", picked AS (SELECT server_uuid, trx_id AS n FROM holed INTERSECT SELECT server_uuid, n FROM done)" + _NUMBERS)
def gtid_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.intersect(gtid.intervals(_holed(spark, folder)), _done(spark))


@query("WITH {ops}" + _DONE_N + ", mine AS (SELECT DISTINCT server_uuid, trx_id AS n FROM trx) SELECT server_uuid, bool_and(mine.n IS NOT NULL) AS contained FROM done LEFT JOIN mine USING (server_uuid, n) GROUP BY server_uuid")
def gtid_contains(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.contains(gtid.intervals(_trx(spark, folder)), _done(spark))


@query(_ISLANDS + " SELECT server_uuid, server_uuid || ':' || string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END, ':' ORDER BY s) AS gtid FROM islands GROUP BY server_uuid")
def gtid_text(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.interval_text(gtid.intervals(_holed(spark, folder)))


@query(_ISLANDS + " SELECT server_uuid, s, e, true AS valid FROM islands UNION ALL VALUES (NULL, NULL, NULL, false), ('" + _U.format(1) + "', 9, 3, false)")
def gtid_parse(spark: SparkSession, folder: str) -> DataFrame:
    odd = spark.createDataFrame([("not-a-uuid:1-2",), (_U.format(1) + ":9-3",)], "gtid string")
    return gtid.parse(gtid_text(spark, folder).select("gtid").union(odd)).select("server_uuid", "s", "e", "valid")


@query("""WITH {ops}, t AS (SELECT server_uuid, mark, db FROM (SELECT server_uuid, db, max(trx_id) AS mark FROM ops GROUP BY ALL))
  SELECT db, CASE WHEN mark % 2 = 0 THEN server_uuid END AS server_uuid, CASE WHEN mark % 2 = 0 THEN mark END AS mark, mark % 2 = 0 AS valid FROM t""")
def gtid_strict_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """For each database its servers' last transactions as one text, of which odd ones are written as a single number."""
    last = oplog.read(spark, folder).groupBy("db", "server_uuid").agg(F.max("trx_id").alias("n"))
    one = F.concat("server_uuid", F.when(F.col("n") % 2 == 0, ":1-").otherwise(":"), F.col("n").cast("string"))
    said = last.groupBy("db").agg(F.array_join(F.collect_list(one), ", ").alias("gtid"))
    return gtid.parse_ranges(said).select("db", "server_uuid", "mark", "valid")


@query(_ISLANDS + ", done(u, a, z) AS (VALUES " + ", ".join(f"('{_U.format(u)}', {s}, {e})" for u, s, e in _DONE) + ") SELECT server_uuid, s, e FROM islands SEMI JOIN done ON server_uuid = u AND s <= z AND e >= a")
def gtid_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.overlapping(gtid.intervals(_holed(spark, folder)), _done(spark))


@query(_HOLED + ", a AS (SELECT server_uuid, trx_id % 40 AS n FROM holed), b AS (SELECT server_uuid, trx_id % 40 AS n FROM trx WHERE server_uuid NOT LIKE '00000001%' OR trx_id % 40 <> 7) SELECT server_uuid, bool_and(a.n IS NOT NULL AND b.n IS NOT NULL) AS equal FROM (SELECT DISTINCT * FROM a) AS a FULL JOIN (SELECT DISTINCT * FROM b) AS b USING (server_uuid, n) GROUP BY server_uuid")
def gtid_equal(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda df: gtid.intervals(df.select("server_uuid", (F.col("trx_id") % 40).alias("trx_id")))
    return gtid.same(part(_holed(spark, folder)), part(_trx(spark, folder).where("server_uuid not like '00000001%' or trx_id % 40 <> 7")))


@query(_ISLANDS + " SELECT CAST(row_number() OVER (ORDER BY server_uuid, list) AS INTEGER) AS place, server_uuid, len(list) AS n FROM (SELECT server_uuid, list(struct_pack(s := s, e := e) ORDER BY s) AS list FROM islands GROUP BY server_uuid)")
def gtid_order(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    sets = gtid.as_arrays(gtid.intervals(_holed(spark, folder)))  # a row a server, so one window is small
    return sets.select(F.row_number().over(Window.orderBy("server_uuid", "intervals")).alias("place"), "server_uuid", F.size("intervals").cast("long").alias("n"))


def _sent(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions by domain-server-sequence: two domains, three servers in turn; the next server sends three of seven again."""
    trx = _trx(spark, folder)
    n = F.col("trx_no")
    ids = trx.select((n % 2).alias("domain"), (F.floor(n / 10.0).cast("long") % 3 + 1).alias("server_id"), (F.floor(n / 2.0).cast("long") + 1).alias("seq"), "pos", "trx_no")
    again = ids.where("trx_no % 7 < 3").select("domain", (F.col("server_id") % 3 + 1).alias("server_id"), "seq", (F.col("pos") + 100_000_000).alias("pos"), "trx_no")
    return ids.union(again).drop("trx_no")


_SENT = """WITH {ops}, ids AS (SELECT trx_no % 2 AS domain, CAST(floor(trx_no / 10.0) AS BIGINT) % 3 + 1 AS server_id, CAST(floor(trx_no / 2.0) AS BIGINT) + 1 AS seq, pos, trx_no FROM trx),
  sent AS (SELECT domain, server_id, seq, pos FROM ids UNION ALL SELECT domain, server_id % 3 + 1, seq, pos + 100000000 FROM ids WHERE trx_no % 7 < 3),
  fresh AS (SELECT domain, server_id, seq, pos FROM (SELECT *, max(seq) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sent) WHERE m IS NULL OR seq > m)"""


@query(_SENT + " SELECT * FROM fresh")
def domain_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return domain_ids.first_seen(_sent(spark, folder))


@query(_SENT + " SELECT string_agg(domain || '-' || server_id || '-' || seq, ',' ORDER BY domain) AS gtid FROM (SELECT domain, max(seq) AS seq, arg_min(server_id, pos) AS server_id FROM (SELECT *, max(seq) OVER (PARTITION BY domain) AS top FROM sent) WHERE seq = top GROUP BY domain)")
def domain_high_water(spark: SparkSession, folder: str) -> DataFrame:
    return domain_ids.text(domain_ids.high_water(domain_ids.first_seen(_sent(spark, folder))))


@query(_SENT + " SELECT domain, pos, seq, p AS from_server, server_id AS to_server FROM (SELECT *, lag(server_id) OVER (PARTITION BY domain ORDER BY pos) AS p FROM fresh) WHERE p <> server_id")
def domain_handovers(spark: SparkSession, folder: str) -> DataFrame:
    return domain_ids.handovers(_sent(spark, folder))


@query(_SENT + ", marks AS (SELECT domain, CAST(floor(max(seq) / 2) AS BIGINT) AS mark FROM sent WHERE domain = 1 GROUP BY domain) SELECT sent.* FROM sent LEFT JOIN marks USING (domain) WHERE mark IS NULL OR seq > mark")
def domain_start_after(spark: SparkSession, folder: str) -> DataFrame:
    """Behind a mark that is read from its text: half of one domain."""
    sent = _sent(spark, folder)
    half = domain_ids.high_water(sent.where("domain = 1")).withColumn("seq", F.floor(F.col("seq") / 2).cast("long"))
    return domain_ids.start_after(sent, domain_ids.parse(domain_ids.text(half)).where("valid")).select("domain", "server_id", "seq", "pos")


def _le(n: str) -> str:
    return "(" + " || ".join(f"substr(printf('%016X', CAST({n} AS BIGINT)), {k}, 2)" for k in range(15, 0, -2)) + ")"


@query(_ISLANDS + f", x AS (SELECT server_uuid, upper(replace(server_uuid, '-', '')) || {_le('count(*)')} || string_agg({_le('s')} || {_le('e + 1')}, '' ORDER BY s) AS x FROM islands GROUP BY server_uuid) SELECT {_le('count(*)')} || string_agg(x, '' ORDER BY server_uuid) AS gtid_hex FROM x")
def gtid_binary(spark: SparkSession, folder: str) -> DataFrame:
    return gtid.encoded(gtid.intervals(_holed(spark, folder)))


# -- transactions ----------------------------------------------------------------------------------

_GROUPS = "WITH {ops}, c AS (SELECT *, CASE WHEN last_committed = lag(last_committed) OVER (ORDER BY trx_no) THEN 0 ELSE 1 END AS o FROM trx), g AS (SELECT *, CAST(sum(o) OVER (ORDER BY trx_no) AS BIGINT) AS gid FROM c)"


@query(_GROUPS + " SELECT gid, last_committed, min(trx_no) AS first_trx, count(*) AS n_trx, CAST(sum(n_ops) AS BIGINT) AS n_ops FROM g GROUP BY gid, last_committed")
def commit_groups(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.group_sizes(transactions.commit_groups(_trx(spark, folder)))


@query(_GROUPS.replace("CASE WHEN", "CASE WHEN trx_no % 7 <> 0 AND") + " SELECT gid, last_committed, min(trx_no) AS first_trx, count(*) AS n_trx, CAST(sum(n_ops) AS BIGINT) AS n_ops FROM g GROUP BY gid, last_committed")
def commit_groups_barrier(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.group_sizes(transactions.commit_groups(_trx(spark, folder), F.col("trx_no") % 7 == 0))


@query(_GROUPS + " SELECT trx_no, gid, CAST(floor((row_number() OVER (PARTITION BY gid ORDER BY trx_no) - 1) / 3) AS BIGINT) AS part FROM g")
def commit_groups_max_count(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.capped_groups(transactions.commit_groups(_trx(spark, folder)), 3).select("trx_no", "gid", "part")


@query(_GROUPS.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT trx_no, CAST(max(floor(epoch(ts))) AS BIGINT) AS sec FROM ops GROUP BY trx_no),
  n AS MATERIALIZED (SELECT trx_no, gid, sec, row_number() OVER (ORDER BY trx_no) AS i FROM g JOIN w USING (trx_no)),
  r AS (
    SELECT i, trx_no, gid, sec, sec AS clock, 1 AS held, CAST(1 AS BIGINT) AS batch FROM n WHERE i = 1
    UNION ALL
    SELECT n.i, n.trx_no, n.gid, n.sec, CASE WHEN f THEN r.sec ELSE clock END, CASE WHEN f THEN 1 ELSE held + 1 END, batch + CASE WHEN f THEN 1 ELSE 0 END
    FROM (SELECT *, i + 1 AS next_i FROM r) AS r JOIN n ON n.i = next_i, LATERAL (SELECT n.gid <> r.gid OR r.held >= 4 OR r.sec - r.clock >= 2400 AS f)
  )
  SELECT trx_no, gid, batch FROM r""")
def commit_groups_max_delay(spark: SparkSession, folder: str) -> DataFrame:
    ops = oplog.read(spark, folder)
    trx = ops.groupBy("trx_no", "last_committed").agg(F.count("*").alias("n_ops"), F.max(F.unix_timestamp("ts")).alias("at"))
    return transactions.flushed_groups(transactions.commit_groups(trx), 2400, 4).select("trx_no", "gid", "batch")


@query(_GROUPS + " SELECT trx_no, gid, (row_number() OVER (PARTITION BY gid ORDER BY trx_no) - 1) % 4 AS worker FROM g")
def parallel_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.schedule(transactions.commit_groups(_trx(spark, folder)), 4).select("trx_no", "gid", "worker")


@query("WITH {ops}, e AS (SELECT *, CAST(sum(CASE WHEN pos % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY db, tab ORDER BY pos) AS BIGINT) AS epoch FROM ops) SELECT db, tab, epoch, min(pos) AS first_pos, count(*) AS n FROM e GROUP BY db, tab, epoch")
def ddl_epochs(spark: SparkSession, folder: str) -> DataFrame:
    marked = transactions.epochs(oplog.read(spark, folder), F.col("pos") % 97 == 0)
    return marked.groupBy("db", "tab", "epoch").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query("WITH {ops}, e AS (SELECT *, CAST(sum(CASE WHEN pos % 997 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY db, tab ORDER BY pos) AS BIGINT) AS epoch FROM ops), l AS (SELECT *, max(epoch) OVER (PARTITION BY db, tab) AS top FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM l WHERE epoch = top) SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'")
def fold_after_truncate(spark: SparkSession, folder: str) -> DataFrame:
    marked = transactions.epochs(oplog.read(spark, folder), F.col("pos") % 997 == 0)
    top = marked.groupBy("db", "tab").agg(F.max("epoch").alias("epoch"))
    return fold.replace(marked.join(top, ["db", "tab", "epoch"], "left_semi"))


_ENTRIES = """WITH {ops}, entries AS (
  SELECT trx_no * 100 AS seq, 'gtid' AS kind FROM trx WHERE trx_no % 31 <> 0
  UNION ALL SELECT trx_no * 100 + 1, 'begin' FROM trx WHERE trx_no % 29 <> 0
  UNION ALL SELECT trx_no * 100 + 2 + pos % 4, 'dml' FROM ops
  UNION ALL SELECT trx_no * 100 + 9, 'xid' FROM trx WHERE trx_no % 37 <> 0
), s AS (SELECT seq, kind, coalesce(lag(kind) OVER (ORDER BY seq), '') AS prev FROM entries)"""


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    ops, trx = oplog.read(spark, folder), _trx(spark, folder)
    at = F.col("trx_no") * 100
    return (
        trx.where("trx_no % 31 <> 0").select(at.alias("seq"), F.lit("gtid").alias("kind"))
        .union(trx.where("trx_no % 29 <> 0").select(at + 1, F.lit("begin")))
        .union(ops.select(at + 2 + F.col("pos") % 4, F.lit("dml")))
        .union(trx.where("trx_no % 37 <> 0").select(at + 9, F.lit("xid")))
    )


@query(_ENTRIES + " SELECT seq, prev, kind FROM s WHERE NOT ((kind = 'gtid' AND prev IN ('', 'xid')) OR (kind = 'begin' AND prev = 'gtid') OR (kind IN ('dml', 'xid') AND prev IN ('begin', 'dml')))")
def state_machine_violations(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.order_violations(_entries(spark, folder))


@query(_GROUPS + " SELECT count(*) AS trx, count(DISTINCT gid) AS merge_trx FROM g")
def trx_counters(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.transaction_counters(transactions.commit_groups(_trx(spark, folder)))


# -- folds -----------------------------------------------------------------------------------------

_FOLD = "WITH {ops}, r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM ops)"


@query(_FOLD + " SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'")
def fold_replace(spark: SparkSession, folder: str) -> DataFrame:
    return fold.replace(oplog.read(spark, folder))


@query(_FOLD + ", b AS (SELECT db, tab, pk, arg_max(op, pos) AS born FROM ops WHERE op <> 'update' GROUP BY ALL) SELECT r.db, r.tab, r.pk, value, props FROM r JOIN b USING (db, tab, pk) WHERE n = 1 AND born = 'insert'")
def fold_update_mode(spark: SparkSession, folder: str) -> DataFrame:
    return fold.update_only(oplog.read(spark, folder))


_LIVES = """WITH {ops}, d AS (SELECT *, coalesce(max(pos) FILTER (op = 'delete') OVER (PARTITION BY db, tab, pk), -2) AS dead FROM ops),
  i AS (SELECT *, min(pos) FILTER (op = 'insert') OVER (PARTITION BY db, tab, pk) AS born FROM d WHERE pos > dead)"""


@query(_LIVES + ", r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM i WHERE pos = born OR (op = 'update' AND pos > born)) SELECT db, tab, pk, value, props FROM r WHERE n = 1")
def fold_insert_mode(spark: SparkSession, folder: str) -> DataFrame:
    return fold.insert_only(oplog.read(spark, folder))


@query(_LIVES + " SELECT pos, db, tab, pk FROM i WHERE op = 'insert' AND pos > born")
def refused_inserts(spark: SparkSession, folder: str) -> DataFrame:
    return fold.refused_inserts(oplog.read(spark, folder))


@query("""WITH {ops}, m AS (
  SELECT pos * 2 AS pos, op, db, tab, pk, value, props FROM ops WHERE NOT (op = 'update' AND pos % 50 = 0)
  UNION ALL SELECT pos * 2, 'delete', db, tab, pk, value, props FROM ops WHERE op = 'update' AND pos % 50 = 0
  UNION ALL SELECT pos * 2 + 1, 'insert', db, tab, pk + 1000, value, props FROM ops WHERE op = 'update' AND pos % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM m) SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'""")
def fold_pk_move(spark: SparkSession, folder: str) -> DataFrame:
    ops = oplog.read(spark, folder).select("pos", "op", *fold.KEY, *fold.ROW)
    moved = ops.withColumn("new_pk", F.when((F.col("op") == "update") & (F.col("pos") % 50 == 0), F.col("pk") + 1000).otherwise(F.col("pk")))
    return fold.replace(fold.split_moves(moved))


# A table without a key: every change is an event's (event_type, user_id % 50, null for some); each is replayed by counting, per
# content, what was put after the last taking.
_BAG = """WITH c AS (SELECT event_id AS pos, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, user_id % 50 AS a,
    CASE WHEN user_id % 11 = 0 THEN NULL ELSE event_id % 3 END AS b, user_id % 50 AS a0, CASE WHEN user_id % 11 = 0 THEN NULL ELSE (event_id + 1) % 3 END AS b0 FROM events),
  put AS (SELECT pos, a, b FROM c WHERE op <> 'delete'), taken AS (SELECT pos, a, b FROM c WHERE op = 'delete' UNION ALL SELECT pos, a0, b0 FROM c WHERE op = 'update')"""


@query(_BAG + " SELECT a, b, count(*) AS copies FROM put AS p WHERE NOT EXISTS (SELECT 1 FROM taken AS t WHERE t.a = p.a AND t.b = p.b AND t.pos >= p.pos) GROUP BY a, b")
def fold_no_pk(spark: SparkSession, folder: str) -> DataFrame:
    events = oplog.table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    b = lambda n: F.when(F.col("user_id") % 11 != 0, n % 3)
    ops = events.select(F.col("event_id").alias("pos"), kind.alias("op"), (F.col("user_id") % 50).alias("a"), b(F.col("event_id")).alias("b"), F.struct((F.col("user_id") % 50).alias("a"), b(F.col("event_id") + 1).alias("b")).alias("before"))
    return fold.bag(ops, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("copies"))


@query("""WITH {ops}, s AS (SELECT event_id AS pos, event_id % 3 AS k, CASE WHEN user_id % 10 = 9 THEN 'mysql' WHEN user_id % 10 = 8 THEN 'audit' ELSE 'shop' END AS db, CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'carts' END AS tab FROM events WHERE event_id % 499 = 0),
  l AS (SELECT * FROM ops AS o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.db = o.db AND s.pos >= o.pos AND (k = 2 OR s.tab = o.tab))),
  r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM l) SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'""")
def fold_after_drop(spark: SparkSession, folder: str) -> DataFrame:
    ops = oplog.read(spark, folder)
    kinds = F.get(F.array(F.lit("ddl_truncate_table"), F.lit("ddl_drop_table"), F.lit("ddl_drop_database")), (F.col("pos") % 3).cast("int"))
    return fold.replace(fold.surviving(ops, ops.where("pos % 499 = 0").select("pos", kinds.alias("kind"), "db", "tab")))


_LATER = [("ddl_rename_table", 499, 0, "db", "tab", "db", "tab || '_' || pos"), ("ddl_rename_table", 998, 250, "db", "tab || '_' || pos", "'archive'", "tab || '_' || pos"), ("ddl_drop_table", 1996, 300, "'archive'", "tab || '_' || pos", "''", "''")]


@query("WITH RECURSIVE {ops}, st AS (" + " UNION ALL ".join(f"SELECT 2 * (pos + {d}) + 1 AS k, {db} AS db, {tab} AS tab, {ndb} AS ndb, {ntab} AS ntab FROM ops WHERE pos % {n} = 0" for _, n, d, db, tab, ndb, ntab in _LATER) + """
  UNION ALL SELECT 2 * pos + 1, db, NULL, '', '' FROM ops WHERE pos = 700),
  walk AS (SELECT pos AS id, 2 * pos AS seen, db, tab FROM ops UNION ALL SELECT w.id, min(s.k), arg_min(s.ndb, s.k), arg_min(s.ntab, s.k) FROM walk w JOIN st s ON s.k > w.seen AND s.db = w.db AND (s.tab = w.tab OR s.tab IS NULL) GROUP BY w.id),
  named AS (SELECT id, arg_max(db, seen) AS ndb, arg_max(tab, seen) AS ntab FROM walk GROUP BY id), r AS (SELECT ndb AS db, ntab AS tab, pk, value, props, op, row_number() OVER (PARTITION BY ndb, ntab, pk ORDER BY pos DESC) AS n FROM ops JOIN named ON id = pos WHERE ndb <> '')
  SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'""")
def fold_after_rename(spark: SparkSession, folder: str) -> DataFrame:
    """Renames now and then, of some tables twice, a drop of what was renamed, a drop of a database."""
    ops = oplog.read(spark, folder)
    return fold.replace(fold.followed(ops, _later_statements(ops)))


def _later_statements(ops: DataFrame) -> DataFrame:
    each = [ops.where(f"pos % {n} = 0").selectExpr(f"pos + {d} AS pos", f"'{kind}' AS kind", f"{db} AS db", f"{tab} AS tab", f"{ndb} AS new_db", f"{ntab} AS new_tab") for kind, n, d, db, tab, ndb, ntab in _LATER]
    each.append(ops.where("pos = 700").selectExpr("pos", "'ddl_drop_database' AS kind", "db", "CAST(NULL AS string) AS tab", "'' AS new_db", "'' AS new_tab"))
    return reduce(DataFrame.unionByName, each)


# Statements on all tables: behind which position, and the text.
_ALTERS = (
    (-1, "CREATE TABLE IF NOT EXISTS `%s`.`%s` (`pk` INT, value DOUBLE, props VARCHAR(99) DEFAULT 'x, (y)', PRIMARY KEY (pk), KEY k (value, props)) ENGINE=InnoDB"),
    (300, "ALTER TABLE `%s`.`%s` ADD COLUMN `note, old` VARCHAR(20) DEFAULT 'a, b' AFTER pk"),
    (500, "ALTER TABLE `%s`.`%s` RENAME COLUMN value TO amount, DROP COLUMN props"),
    (700, "ALTER TABLE `%s`.`%s` CHANGE `note, old` note TEXT, ADD tag INT DEFAULT 7 FIRST"),
    (900, "ALTER TABLE `%s`.`%s` MODIFY COLUMN amount DOUBLE AFTER tag, ADD INDEX i (note)"),
)


@query("""WITH {ops}, r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM ops)
  SELECT db, tab, pk, CASE WHEN pos <= 700 THEN '7' ELSE CAST(pos % 13 AS VARCHAR) END AS tag, CAST(pos % 1000 AS VARCHAR) AS amount, CASE WHEN pos <= 300 THEN 'a, b' ELSE 'n' || CAST(pos % 7 AS VARCHAR) END AS note, 4 AS n_columns
  FROM r WHERE n = 1 AND op <> 'delete'""")
def fold_after_alter(spark: SparkSession, folder: str) -> DataFrame:
    """Images by place, as their table's columns were when they were written, under the columns that it has in the end."""
    text = lambda c: c.cast("string")
    pos, pk = F.col("pos"), text(F.col("pk"))
    tag, amount, note = text(pos % 13), text(pos % 1000), F.concat(F.lit("n"), text(pos % 7))
    image = (
        F.when(pos <= 300, F.array(pk, amount, F.col("props"))).when(pos <= 500, F.array(pk, note, amount, F.col("props"))).when(pos <= 700, F.array(pk, note, amount))
        .when(pos <= 900, F.array(tag, pk, note, amount)).otherwise(F.array(tag, amount, pk, note))
    )
    ops = oplog.read(spark, folder).withColumn("image", image)
    tables = ops.select("db", "tab").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("pos"), F.lit(q).alias("query")) for p, q in _ALTERS)))
    said = tables.select("db", "tab", each.alias("one")).select("one.pos", F.replace("one.query", F.lit("`%s`.`%s`"), F.format_string("`%s`.`%s`", "db", "tab")).alias("query"), F.lit("").alias("schema_ctx"))
    named = statements.with_names(statements.classify(said))
    last = ops.groupBy(*fold.KEY).agg(F.max_by(F.struct("op", "image"), "pos").alias("last"), F.max("pos").alias("pos")).where("last.op <> 'delete'").select("pos", *fold.KEY, "last.image")
    out = schema.projected(last, schema.versions(schema.column_changes(named)))
    return out.select(*fold.KEY, *(F.element_at("image", F.lit(c)).alias(c) for c in ("tag", "amount", "note")), F.size("image").alias("n_columns"))


@query("""WITH {ops}, o AS (SELECT * FROM ops WHERE pos >= 2000), b AS (SELECT -1 AS pos, 'insert' AS op, db, tab, pk, value, props FROM (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM ops WHERE pos < 2000) WHERE n = 1 AND op <> 'delete'),
  m AS (SELECT pos, op, db, tab, pk, value, props FROM o UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY db, tab, pk ORDER BY pos DESC) AS n FROM m) SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'""")
def fold_onto_base(spark: SparkSession, folder: str) -> DataFrame:
    ops = oplog.read(spark, folder)
    return fold.replace(fold.with_base(ops.where("pos >= 2000"), fold.replace(ops.where("pos < 2000"))))


@query("""WITH {ops}, d AS (SELECT *, coalesce(max(pos) FILTER (op = 'delete') OVER (PARTITION BY db, tab, pk), -2) AS dead FROM ops), a AS (SELECT * FROM d WHERE pos > dead),
  v AS (SELECT DISTINCT ON (db, tab, pk) db, tab, pk, value FROM a WHERE pos % 3 <> 0 ORDER BY db, tab, pk, pos DESC), p AS (SELECT DISTINCT ON (db, tab, pk) db, tab, pk, props FROM a WHERE pos % 5 <> 0 ORDER BY db, tab, pk, pos DESC),
  b AS (SELECT DISTINCT db, tab, pk FROM a WHERE op = 'insert') SELECT b.db, b.tab, b.pk, value, props FROM b LEFT JOIN v USING (db, tab, pk) LEFT JOIN p USING (db, tab, pk)""")
def fold_partial_images(spark: SparkSession, folder: str) -> DataFrame:
    present = F.create_map(F.lit("value"), F.col("pos") % 3 != 0, F.lit("props"), F.col("pos") % 5 != 0)
    return fold.partial(oplog.read(spark, folder).withColumn("present", present))


# -- metrics ---------------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (op = '{op}' AND {ok}) AS dml_{op}{end}_total" for op in metrics.OPS for end, ok in (("", "ok"), ("_skip", "NOT ok")))
_DML = "WITH {ops}, a AS (SELECT *, db || '.' || tab <> 'audit.users' AND db NOT IN ('mysql', 'archive') AND db IN ('shop', 'audit') AS ok FROM ops), c AS (SELECT db, tab, " + _COUNTS + " FROM a GROUP BY db, tab)"


@query(_DML + " SELECT * FROM c")
def dml_counters(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.change_counters(oplog.read(spark, folder), RULE.accepts(F.col("db"), F.col("tab")))


@query(_DML + " SELECT CAST(json_object(" + ", ".join(f"'dml_{op}{end}_total', CAST(sum(dml_{op}{end}_total) AS BIGINT)" for op in metrics.OPS for end in ("", "_skip")) + ") AS VARCHAR) AS metrics FROM c")
def metrics_json(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.as_json(dml_counters(spark, folder))


_OK = "db || '.' || tab <> 'audit.users' AND db NOT IN ('mysql', 'archive') AND db IN ('shop', 'audit')"
_KINDS = (*(f"dml_{op}" for op in metrics.OPS), "ddl_database", "ddl_table")


@query(f"""WITH {{ops}}, {_STMT}, r AS (SELECT 'dml_' || op AS kind, {_OK} AS ok FROM ops
  UNION ALL SELECT CASE WHEN kind LIKE '%database' THEN 'ddl_database' ELSE 'ddl_table' END, db <> 'mysql' FROM named WHERE kind LIKE 'ddl%')
  SELECT count(*) AS extractor_operations, count(*) FILTER (ok) AS applier_operations, """ + ", ".join(
    f"count(*) FILTER (kind = '{kind}' AND {ok}) AS {side}_{kind}{end}_total" for side, end, ok in (("extractor_operation", "", "true"), ("applier_operation", "", "ok"), ("applier_operation", "_skip", "NOT ok")) for kind in _KINDS
) + " FROM r")
def operation_counters(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.operation_counters(oplog.read(spark, folder), _named(spark, folder), RULE.accepts(F.col("db"), F.col("tab")), F.col("db") != "mysql")


_COUNTED = ", ".join(f"'{s}'" for s in metrics.NON_DML)


@query(_GROUPS + f""", {_STMT}, n AS (SELECT replace(replace(kind, 'ddl_', ''), '_', '') AS what FROM named WHERE kind LIKE 'ddl%')
  SELECT (SELECT count(*) FROM g) AS trx, (SELECT count(DISTINCT gid) FROM g) AS merge_trx, (SELECT count(*) FROM n WHERE what IN ({_COUNTED})) AS nondml,
  (SELECT CAST(max(floor(epoch(ts))) - max(floor(epoch(ts))) FILTER ({_OK}) AS BIGINT) FROM ops) AS delay, """ + ", ".join(
    [f"(SELECT count(*) FROM ops WHERE op = '{op}') AS dml_{op}" for op in metrics.OPS] + [f"(SELECT count(*) FROM n WHERE what = '{s}') AS nondml_{s}" for s in metrics.NON_DML]
))
def replication_counters(spark: SparkSession, folder: str) -> DataFrame:
    groups = transactions.commit_groups(_trx(spark, folder))
    return metrics.replication_counters(oplog.read(spark, folder), _named(spark, folder), groups, RULE.accepts(F.col("db"), F.col("tab")))


@query("WITH {ops} SELECT op, count(*) AS n FROM ops GROUP BY GROUPING SETS ((op), ())")
def op_totals(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.totals(oplog.read(spark, folder))


@query("WITH {ops} SELECT server_uuid, max(pos) AS binlog_pos, arg_max(ts, pos) AS last_ts, arg_max(trx_id, pos) AS last_gno FROM ops GROUP BY server_uuid")
def last_gauges(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.gauges(oplog.read(spark, folder))


@query("""WITH {ops}, m AS (SELECT server_uuid, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS poll, max(trx_id) AS mark FROM ops GROUP BY ALL)
  SELECT server_uuid, poll, mark, round((mark - lag(mark) OVER w) / (poll - lag(poll) OVER w), 6) AS rate FROM m WINDOW w AS (PARTITION BY server_uuid ORDER BY poll)""")
def gno_rate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.number_rate(oplog.read(spark, folder), 3600)


@query("""WITH {ops}, s AS (SELECT db, CAST(floor(epoch(ts)) AS BIGINT) AS second, max(trx_no % 31) AS delay FROM ops GROUP BY ALL),
  o AS (SELECT *, delay - 1 < 10 AS low, lag(delay - 1 < 10) OVER w AS before_low FROM s WINDOW w AS (PARTITION BY db ORDER BY second)),
  g AS (SELECT *, sum(CASE WHEN low OR coalesce(before_low, true) THEN 1 ELSE 0 END) OVER (PARTITION BY db ORDER BY second) AS run FROM o)
  SELECT db, second, delay, NOT low AND second - min(second) OVER (PARTITION BY db, run) >= 3600 AS firing FROM g""")
def delay_alert(spark: SparkSession, folder: str) -> DataFrame:
    delays = oplog.read(spark, folder).select("db", F.unix_timestamp("ts").alias("second"), (F.col("trx_no") % 31).alias("delay"))
    return metrics.delay_alert(delays, 10, 3600)


# -- comparison ------------------------------------------------------------------------------------

_ALTERED = "a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 89 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 77 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 100 <> 0)"


def _pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    a = oplog.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.col("o_orderkey")
    b = a.where(key % 100 != 0).select((key + F.when(key % 89 == 0, 100_000_000).otherwise(0)).alias("o_orderkey"), "o_custkey", F.when(key % 77 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return a, b


@query("WITH " + _ALTERED + " SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey <> b.o_custkey OR a.o_orderstatus <> b.o_orderstatus")
def table_compare(spark: SparkSession, folder: str) -> DataFrame:
    return compare.by_key(*_pair(spark, folder), ["o_orderkey"])


@query(SQL["table_compare"])
def table_compare_tree(spark: SparkSession, folder: str) -> DataFrame:
    return compare.by_key_tree(*_pair(spark, folder), ["o_orderkey"])


@query("WITH " + _ALTERED + ", x AS (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b), y AS (SELECT o_custkey, o_orderstatus, CAST(sum(n) AS BIGINT) AS m FROM x GROUP BY ALL) SELECT o_custkey, o_orderstatus, CASE WHEN m > 0 THEN 'source' ELSE 'target' END AS side, abs(m) AS copies FROM y WHERE m <> 0")
def bag_compare(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _pair(spark, folder)
    return compare.as_bags(a.drop("o_orderkey"), b.drop("o_orderkey"))


@query("WITH {ops} SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', pos, db, tab, pk, coalesce(props, '\\N'))), 1, 8) AS BIGINT)) AS BIGINT) AS hash FROM ops")
def snapshot_hash(spark: SparkSession, folder: str) -> DataFrame:
    return compare.table_hash(oplog.read(spark, folder), [F.col(c) for c in ("pos", "db", "tab", "pk", "props")])


def _maps_and_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The changes as row events, with a table map of their table before every 50th; a map's columns are its position here."""
    ops = oplog.read(spark, folder)
    head = F.unhex(F.when(F.col("tab") == "users", "C80000000000").otherwise("2A0100000000"))  # table ids 200 and 298
    event = lambda pos, kind, body: ops.select(F.lit("log.1").alias("src_file"), pos.alias("pos"), F.unix_timestamp("ts").alias("ts"), F.lit(kind).alias("kind"), body.alias("body"), "tab", F.col("pos").alias("at"))
    maps = event(F.col("pos") * 2, "table_map", F.concat(head, F.col("pos").cast("string").cast("binary"))).where("at % 50 = 0")
    return maps.union(event(F.col("pos") * 2 + 1, "write_rows", head))


def _map_position() -> Column:
    return F.substring(F.col("map"), 7, 20).cast("string").cast("long")


@query("WITH {ops}, m AS (SELECT tab, pos, 'v' || CAST(floor(pos / 500) AS BIGINT) AS columns FROM ops WHERE pos % 50 = 0) SELECT o.pos, o.tab, m.columns FROM ops AS o ASOF JOIN m ON o.tab = m.tab AND o.pos >= m.pos")
def tablemap_asof(spark: SparkSession, folder: str) -> DataFrame:
    seen = binlog.mapped(_maps_and_rows(spark, folder))
    return seen.select(F.col("at").alias("pos"), "tab", F.concat(F.lit("v"), F.floor(_map_position() / 500).cast("string")).alias("columns"))


@query("WITH {ops}, m AS (SELECT tab, min(pos) AS first_pos FROM ops WHERE pos % 50 = 0 GROUP BY tab) SELECT pos, tab, first_pos FROM ops JOIN m USING (tab) WHERE pos >= first_pos")
def frozen_schema(spark: SparkSession, folder: str) -> DataFrame:
    seen = binlog.mapped(_maps_and_rows(spark, folder), freeze=True)
    return seen.select(F.col("at").alias("pos"), "tab", _map_position().alias("first_pos"))


# Event bodies written by hand from the format's description, and what they say.
_BODIES = (
    ("rotate", "04000000000000006c6f672e32", {"position": 4, "next": "log.2"}),
    ("xid", "4d00000000000000", {"xid": 77}),
    ("intvar", "020900000000000000", {"of": 2, "value": 9}),
    ("rand", "01000000000000000200000000000000", {"seed1": 1, "seed2": 2}),
    ("rows_query", "0853454c4543542031", {"query": "SELECT 1"}),
    ("annotate_rows", "53454c4543542031", {"query": "SELECT 1"}),
    ("heartbeat", "6c6f672e31", {"file": "log.1"}),
    ("user_var", "010000006e00023f00000008000000fcffffffffffffff00", {"name": "n", "of": 2, "charset": 63, "value": -4}),
    ("gtid", "010123456789abcdef0123456789abcdef0700000000000000020300000000000000" + "0400000000000000", {"commit_flag": 1, "server_uuid": "01234567-89ab-cdef-0123-456789abcdef", "trx_id": 7, "last_committed": 3, "sequence_number": 4}),
    ("previous_gtids", "01000000000000000123456789abcdef0123456789abcdef0200000000000000010000000000000006000000000000000800000000000000" + "0900000000000000", {"gtids": "01234567-89ab-cdef-0123-456789abcdef:1-5:8"}),
    ("xa_prepare", "010100000002000000010000006162" + "63", {"one_phase": True, "format": 1, "gtrid": "6162", "bqual": "63"}),
    ("begin_load_query", "05000000" + "61622c63", {"file_id": 5, "block": "61622c63"}),
    ("execute_load_query", "0100000002000000010000000007000000020000000900000001" + "64006c6f6164", {"thread_id": 1, "seconds": 2, "error": 0, "file_id": 7, "start": 2, "end": 9, "duplicates": 1, "schema": "d", "status": {}, "query": "load"}),
    ("mariadb_gtid", "08000000000000000100000000", {"domain": 1, "sequence": 8, "flags": 0}),
    ("mariadb_gtid_list", "0100000001000000020000000900000000000000", {"gtids": "1-2-9"}),
    ("binlog_checkpoint", "050000006c6f672e31", {"file": "log.1"}),
    ("start_encryption", "0101000000000102030405060708090a0b", {"scheme": 1, "key_version": 1, "nonce": "000102030405060708090a0b"}),
    ("query", "0100000000000000010000050000050000006400424547494e", {"thread_id": 1, "seconds": 0, "error": 0, "schema": "d", "status": {"flags2": 5}, "query": "BEGIN"}),
)


@query("SELECT event_id AS pos, kind, said FROM (SELECT *, CAST(event_id % " + str(len(_BODIES)) + " AS INTEGER) AS i FROM events) JOIN (VALUES " + ", ".join(f"({i}, '{k}', '{json.dumps(said)}')" for i, (k, _, said) in enumerate(_BODIES)) + ") AS v(i, kind, said) USING (i)")
def event_details(spark: SparkSession, folder: str) -> DataFrame:
    one = F.get(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(raw).alias("raw")) for k, raw, _ in _BODIES)), (F.col("event_id") % len(_BODIES)).cast("int"))
    e = oplog.table(spark, folder, "events").select(F.col("event_id").alias("pos"), one.alias("one")).select("pos", "one.kind", F.unhex("one.raw").alias("body"))
    none = {"src_file": "string", "ts": "long", "type": "int", "server_id": "long", "size": "long", "end_pos": "long", "flags": "int", "checksum_ok": "boolean"}
    whole = e.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).select(*(c.split()[0] for c in binlog.EVENT_TYPES.split(", ")))
    return binlog.with_details(whole).select("pos", "kind", F.col("details").alias("said"))


@query("WITH {ops} SELECT pos, side, CAST(pk AS BIGINT) AS pk FROM (SELECT pos, pk, unnest(CASE op WHEN 'update' THEN ['after', 'before'] WHEN 'insert' THEN ['after'] ELSE ['before'] END) AS side FROM ops)")
def rows_explode(spark: SparkSession, folder: str) -> DataFrame:
    sides = F.when(F.col("op") == "update", F.array(F.lit("before"), F.lit("after"))).when(F.col("op") == "insert", F.array(F.lit("after"))).otherwise(F.array(F.lit("before")))
    return oplog.read(spark, folder).select("pos", "pk", F.explode(sides).alias("side"))


@query("WITH {ops} SELECT db, tab AS table_name, count(*) AS n_changes, min(pos) AS first_pos FROM ops GROUP BY db, tab")
def table_list(spark: SparkSession, folder: str) -> DataFrame:
    """The tables that a log is about."""
    return oplog.read(spark, folder).groupBy("db", F.col("tab").alias("table_name")).agg(F.count("*").alias("n_changes"), F.min("pos").alias("first_pos"))


# -- values ----------------------------------------------------------------------------------------

_LABELS = ["red", "green", "blue", "black"]


@query("SELECT event_id AS pos, array_to_string(list_filter([CASE WHEN event_id & 1 > 0 THEN 'red' END, CASE WHEN event_id & 2 > 0 THEN 'green' END, CASE WHEN event_id & 4 > 0 THEN 'blue' END, CASE WHEN event_id & 8 > 0 THEN 'black' END], lambda x: x IS NOT NULL), ',') AS labels FROM events")
def set_mask_labels(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.table(spark, folder, "events").select(F.col("event_id").alias("pos"), values.set_text(F.col("event_id"), _LABELS).alias("labels"))


@query("SELECT event_id AS pos, (['', 'red', 'green', 'blue', 'black'])[CAST(event_id % 6 AS INTEGER) + 1] AS label FROM events")
def enum_label(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.table(spark, folder, "events").select(F.col("event_id").alias("pos"), values.enum_label(F.col("event_id") % 6, _LABELS).alias("label"))


@query("SELECT event_id AS pos, lpad(bin(event_id), 24, '0') AS bits, CAST(bit_count(event_id) AS INTEGER) AS ones, CAST((event_id >> 2) & 1 AS INTEGER) AS third, event_id AS value FROM events")
def bit_value(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    bits = values.bit_text(n, 24)
    back = F.conv(F.hex(values.bit_bytes(bits)), 16, 10).cast("long")
    return oplog.table(spark, folder, "events").select(n.alias("pos"), bits.alias("bits"), values.bits_set(n).alias("ones"), values.bit_at(n, F.lit(2)).cast("int").alias("third"), back.alias("value"))


@query("SELECT event_id AS pos, (event_id % 100) * 10000 AS micros2, (event_id % 10000) * 100 AS micros4, event_id % 1000000 AS micros6 FROM events")
def fsp_scale(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    return oplog.table(spark, folder, "events").select(n.alias("pos"), values.fraction(n % 100, 1).alias("micros2"), values.fraction(n % 10000, 4).alias("micros4"), values.fraction(n % 1_000_000, 6).alias("micros6"))


@query("SELECT event_id AS pos, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_extract_props(spark: SparkSession, folder: str) -> DataFrame:
    k = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return oplog.table(spark, folder, "events").select(F.col("event_id").alias("pos"), k.alias("k"))


@query("SELECT event_id AS pos, '{\"pos\":' || event_id || ',\"op\":\"' || event_type || '\"}' AS said, length(event_type) AS op_chars FROM events")
def event_json(spark: SparkSession, folder: str) -> DataFrame:
    e = oplog.table(spark, folder, "events")
    return e.select(F.col("event_id").alias("pos"), F.to_json(F.struct(F.col("event_id").alias("pos"), F.col("event_type").alias("op"))).alias("said"), F.length("event_type").cast("long").alias("op_chars"))


@query("WITH t AS (SELECT o_orderkey, ' a' || o_custkey || ', ,b' || o_orderkey || ' ,' AS s, o_orderpriority || '/pw@h' || o_custkey || ':3306' AS dsn FROM orders) SELECT o_orderkey, 'a' || split_part(split_part(s, ',', 1), 'a', 2) || '|' || trim(split_part(s, ',', 3)) AS parts, split_part(dsn, '/', 1) AS user, split_part(split_part(dsn, '@', 2), ':', 1) AS host, CAST(split_part(dsn, ':', 2) AS INTEGER) AS port FROM t")
def text_helpers(spark: SparkSession, folder: str) -> DataFrame:
    o = oplog.table(spark, folder, "orders")
    s = F.concat(F.lit(" a"), F.col("o_custkey").cast("string"), F.lit(", ,b"), F.col("o_orderkey").cast("string"), F.lit(" ,"))
    dsn = F.concat("o_orderpriority", F.lit("/pw@h"), F.col("o_custkey").cast("string"), F.lit(":3306"))
    return o.select("o_orderkey", F.array_join(values.split_clean(s), "|").alias("parts"), values.dsn_part(dsn, "user").alias("user"), values.dsn_part(dsn, "host").alias("host"), values.dsn_part(dsn, "port").cast("int").alias("port"))


@query("SELECT o_custkey, CAST(floor(median(o_orderkey)) AS BIGINT) AS middle FROM orders GROUP BY o_custkey")
def median_int(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.table(spark, folder, "orders").groupBy("o_custkey").agg(F.floor(F.median("o_orderkey")).cast("long").alias("middle"))


@query("SELECT event_id AS pos, CASE WHEN event_id % 5 = 0 THEN 'NULL' WHEN event_id % 5 = 1 THEN 'FROM_UNIXTIME(' || event_id || ')' WHEN event_id % 5 = 2 THEN CAST(event_id AS VARCHAR) ELSE '''' || props || '''' END AS cell FROM events")
def cell_text(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    code = F.when(n % 5 == 1, 17).when(n % 5 == 2, 8).otherwise(253)
    value = F.when(n % 5 == 0, None).when(n % 5 <= 2, n.cast("string")).otherwise(F.col("props"))
    return oplog.table(spark, folder, "events").select(n.alias("pos"), values.cell_text(code, value).alias("cell"))


@query("""SELECT o_orderkey, b AS base, CAST(floor(least(greatest(b, 10), greatest(filled, 10)) / 10) * 10 AS BIGINT) AS fetch FROM (
  SELECT o_orderkey, o_orderkey % 7000 AS filled, CAST(greatest(CASE WHEN o_custkey % 2500 > 1000 THEN floor((o_custkey + 10) / ((o_custkey % 2500) / 1000)) ELSE o_custkey + 10 + CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 0 END END - 10, 10) AS BIGINT) AS b FROM orders)""")
def adaptive_fetch(spark: SparkSession, folder: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base, fetch = values.fetch_count(cust + 10, key % 7000, cust % 2500, 1000, key % 2 == 0)
    return oplog.table(spark, folder, "orders").select("o_orderkey", base.alias("base"), fetch.alias("fetch"))


# -- logs as files, streams ------------------------------------------------------------------------


def _written(spark: SparkSession, folder: str, second: Column | None = None) -> DataFrame:
    """The operation log as a textual log. Texts are many times as long as the events: these are dealt over all cores before, however few row groups hold them."""
    events = oplog.table(spark, folder, "events").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    return textlog.write(oplog.derived(events), second)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return textlog.parse(_written(spark, folder))


@query("""WITH {ops}, l AS (SELECT * FROM ops ORDER BY pos DESC LIMIT 1) SELECT count(*) FILTER (op = 'insert') AS write_rows, count(*) FILTER (op = 'update') AS update_rows, count(*) FILTER (op = 'delete') AS delete_rows,
  count(*) AS table_maps, 0 AS commits, 0 AS rollbacks, arg_max(server_uuid || ':' || trx_id, pos) AS last_gtid, date_trunc('second', max(ts)) AS last_ts, max(pos) * 1000 + 600 AS last_at, 'log.000001' AS last_file FROM ops""")
def text_stats(spark: SparkSession, folder: str) -> DataFrame:
    return textlog.statistics(_records(spark, folder))


@query("WITH {ops} SELECT db, tab, count(*) FILTER (op = 'insert') AS writes, count(*) FILTER (op = 'update') AS updates, count(*) FILTER (op = 'delete') AS deletes FROM ops GROUP BY db, tab")
def table_stats(spark: SparkSession, folder: str) -> DataFrame:
    return textlog.table_statistics(_records(spark, folder))


@query("""WITH {ops}, c AS (SELECT *, '`id` = ' || pk AS i, '`props` = ''' || props || '''' AS p, '`' || db || '`.`' || tab || '`' AS t FROM ops)
  SELECT pos * 1000 + 600 AS at, op, CASE op WHEN 'insert' THEN 'INSERT INTO ' || t || ' SET ' || i || ', ' || p WHEN 'update' THEN 'UPDATE ' || t || ' SET ' || i || ', ' || p || ' WHERE ' || i || ' AND ' || p ELSE 'DELETE FROM ' || t || ' WHERE ' || i || ' AND ' || p END AS sql FROM c""")
def binlog_text_parse(spark: SparkSession, folder: str) -> DataFrame:
    return textlog.statements(_records(spark, folder)).select("at", "op", "sql")


@query("""WITH {ops}, m AS (SELECT db, tab, pos, 'c' || CAST(floor(pos / 500) AS BIGINT) AS name FROM ops WHERE pos % 50 = 0),
  n AS (SELECT o.pos, op, '`' || o.db || '`.`' || o.tab || '`' AS t, CASE WHEN name IS NULL THEN '`@1` = ' ELSE '`id` = ' END || pk AS i, '`' || coalesce(name, '@2') || '` = ' || '''' || props || '''' AS p FROM ops AS o ASOF LEFT JOIN m ON o.db = m.db AND o.tab = m.tab AND o.pos >= m.pos)
  SELECT pos * 1000 + 600 AS at, op, CASE op WHEN 'insert' THEN 'INSERT INTO ' || t || ' SET ' || i || ', ' || p WHEN 'update' THEN 'UPDATE ' || t || ' SET ' || i || ', ' || p || ' WHERE ' || i || ' AND ' || p ELSE 'DELETE FROM ' || t || ' WHERE ' || i || ' AND ' || p END AS sql FROM n""")
def text_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A table map before every 50th change alone, with a second column that is called anew every 500 changes."""
    name = F.concat(F.lit("c"), F.floor(F.col("pos") / 500).cast("string"))
    records = textlog.parse(_written(spark, folder, name)).where("event <> 'Table_map' or at % 50000 = 300")
    return textlog.statements(records).select("at", "op", "sql")


# Files of a partition, which may be one batch in the memory of a task that splits them.
FILES_A_TASK = 16


def _binlog_files(spark: SparkSession, folder: str) -> DataFrame:
    """The operation log as binary logs of 4,000 changes each, in partitions that follow the log."""
    import pandas as pd

    ops = oplog.read(spark, folder).withColumn("file", F.floor(F.col("pos") / 4000)).withColumn("ts", F.unix_timestamp("ts"))
    files = ops.agg(F.count_distinct("file")).first()[0]
    ops = ops.repartitionByRange(max(1, -(-files // FILES_A_TASK)), "file")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        cells = [rows[c].astype(object).where(rows[c].notna(), None).tolist() if rows[c].hasnans else rows[c].tolist() for c in rows]
        return pd.DataFrame({"path": [f"log.{key[0]:06d}"], "content": [binlog_writer.write_changes([dict(zip(rows, r)) for r in zip(*cells)])]})

    return ops.groupBy("file").applyInPandas(one, "path string, content binary")


@query("WITH {ops} SELECT server_uuid, trx_id, last_committed, db, tab, op, pk, CAST(round(value * 100) AS BIGINT) AS cents, props FROM ops")
def binlog_decode(spark: SparkSession, folder: str) -> DataFrame:
    rows = binlog.oplog_of(_binlog_files(spark, folder), last_only=True)
    row = F.from_json(F.coalesce("after", "before"), "pk long, value double, props string")
    return rows.withColumn("row", row).select("server_uuid", "trx_id", "last_committed", "db", "tab", "op", "row.pk", F.round(F.col("row.value") * 100).cast("long").alias("cents"), "row.props")


@query("WITH {ops}, e AS (SELECT 'gtid' AS kind, CAST(floor(pos / 4000) AS BIGINT) AS f, trx_no FROM ops UNION SELECT 'query', CAST(floor(pos / 4000) AS BIGINT), trx_no FROM ops UNION SELECT 'xid', CAST(floor(pos / 4000) AS BIGINT), trx_no FROM ops) SELECT kind, count(*) AS n FROM e GROUP BY kind UNION ALL SELECT 'table_map', count(*) FROM ops UNION ALL SELECT CASE op WHEN 'insert' THEN 'write_rows' ELSE op || '_rows' END, count(*) FROM ops GROUP BY op UNION ALL SELECT 'format_description', count(DISTINCT floor(pos / 4000)) FROM ops")
def binlog_events(spark: SparkSession, folder: str) -> DataFrame:
    return binlog.events(_binlog_files(spark, folder)).where("checksum_ok").groupBy("kind").agg(F.count("*").alias("n"))


@query(_FOLD + " SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'")
def stream_fold(spark: SparkSession, folder: str) -> DataFrame:
    ops = oplog.derived(apply.stream_table(spark, f"{folder}/events.parquet"))
    at = fresh_folder(spark, "stream")
    last = apply.run_available(ops, apply.apply_to(at), f"{at}/checkpoint")
    return apply.snapshot(spark, at, last)


@query(SQL["fold_after_rename"])
def stream_fold_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """Changes and statements as one stream that is stopped and goes on: the log comes in five parts, compacted every second batch."""
    ops, at = oplog.read(spark, folder), fresh_folder(spark, "stream")
    none = [F.lit(None).cast("string").alias(c) for c in ("new_db", "new_tab")]
    log = ops.select("pos", F.lit("row").alias("kind"), "op", *fold.KEY, *fold.ROW, *none).unionByName(_later_statements(ops), allowMissingColumns=True)
    width = log.agg(F.floor(F.max("pos") / 5) + 1).first()[0] or 1
    last = -1
    for k in range(5):
        log.where((F.col("pos") >= k * width) & (F.col("pos") < (k + 1) * width)).write.mode("append").parquet(f"{at}/log")
        last = max(last, apply.run_available(apply.stream_table(spark, f"{at}/log"), log_fold.apply_log(f"{at}/table", 2), f"{at}/checkpoint"))
    return log_fold.snapshot(spark, f"{at}/table", last, 2)


@query(_FOLD + " SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'")
def stream_leveled(spark: SparkSession, folder: str) -> DataFrame:
    """Five batches into a table of runs in levels, merged by twos."""
    ops, at = oplog.read(spark, folder), fresh_folder(spark, "stream")
    width = ops.agg(F.floor(F.max("pos") / 5) + 1).first()[0] or 1
    last = -1
    for k in range(5):
        ops.where((F.col("pos") >= k * width) & (F.col("pos") < (k + 1) * width)).write.mode("append").parquet(f"{at}/log")
        last = max(last, apply.run_available(apply.stream_table(spark, f"{at}/log"), leveled.apply_leveled(f"{at}/table", 8, 2), f"{at}/checkpoint"))
    return leveled.snapshot(spark, f"{at}/table", last, 8)


def _in_parts(spark: SparkSession, rows: DataFrame, order: str, parts: int, at: str, sink: Callable[[DataFrame, int], None], then: DataFrame | None = None) -> int:
    """One stream that is stopped and goes on, of which the rows come in so many parts of the order; `then` comes behind the third. The last batch."""
    width, last = rows.agg(F.floor(F.max(order) / parts) + 1).first()[0] or 1, -1
    for k in range(parts):
        for some in (rows.where((F.col(order) >= k * width) & (F.col(order) < (k + 1) * width)), then if k == 2 else None):
            if some is not None:
                some.write.mode("append").parquet(f"{at}/log")
                last = max(last, apply.run_available(apply.stream_table(spark, f"{at}/log"), sink, f"{at}/checkpoint"))
    return last


@query("""WITH {ops}, c AS (SELECT *, CASE WHEN last_committed = lag(last_committed) OVER (ORDER BY trx_no)
    AND trx_no <> (SELECT min(t.trx_no) FROM trx AS t WHERE t.trx_no >= 3 * (SELECT floor(max(trx_no) / 5) + 1 FROM trx)) THEN 0 ELSE 1 END AS o FROM trx),
  g AS (SELECT *, CAST(sum(o) OVER (ORDER BY trx_no) AS BIGINT) AS gid FROM c)
  SELECT gid, last_committed, min(trx_no) AS first_trx, count(*) AS n_trx, CAST(sum(n_ops) AS BIGINT) AS n_ops FROM g GROUP BY gid, last_committed""")
def stream_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Commit groups of a stream in five parts, which two heartbeats interrupt behind the third."""
    at, trx = fresh_folder(spark, "stream"), _trx(spark, folder).withColumn("kind", F.lit("trx"))
    beats = spark.createDataFrame([(group_log.HEARTBEAT,)] * 2, "kind string")
    beats = trx.limit(0).unionByName(beats, allowMissingColumns=True)
    last = _in_parts(spark, trx, "trx_no", 5, at, group_log.apply_groups(f"{at}/groups"), beats)
    return transactions.group_sizes(group_log.groups(spark, f"{at}/groups", last, with_open=True))


@query(SQL["gtid_gaps"])
def stream_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """What servers pass over, in a stream of five parts."""
    at, trx = fresh_folder(spark, "stream"), _holed(spark, folder).withColumn("kind", F.lit("trx"))
    last = _in_parts(spark, trx, "trx_no", 5, at, group_log.apply_groups(f"{at}/groups"))
    return group_log.gaps(spark, f"{at}/groups", last)


@query(SQL["state_machine_violations"])
def stream_order(spark: SparkSession, folder: str) -> DataFrame:
    """Entries out of order, in a stream of three parts."""
    at = fresh_folder(spark, "stream")
    last = _in_parts(spark, _entries(spark, folder), "seq", 3, at, group_log.check_order(f"{at}/order"))
    return group_log.violations(spark, f"{at}/order", last)


@query("""WITH {ops}, m AS (SELECT server_uuid, CAST(floor(max(trx_id) / 2) AS BIGINT) AS mark FROM trx WHERE server_uuid NOT LIKE '00000002%' GROUP BY server_uuid),
  d AS (SELECT 'all' AS destination, ops.* FROM ops UNION ALL SELECT 'half', ops.* FROM ops LEFT JOIN m USING (server_uuid) WHERE mark IS NULL OR trx_id > mark),
  r AS (SELECT *, row_number() OVER (PARTITION BY destination, db, tab, pk ORDER BY pos DESC) AS n FROM d) SELECT destination, db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'""")
def stream_two_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """One stream that is stopped and goes on, into a new destination and one that has had the first half of two servers."""
    ops, at = oplog.read(spark, folder), fresh_folder(spark, "stream")
    half = gtid.high_water(ops.where("server_uuid not like '00000002%'")).select(F.lit("half").alias("destination"), "server_uuid", F.floor(F.col("mark") / 2).cast("long").alias("mark"))
    sink = apply.fan_out_each({name: apply.apply_to(f"{at}/{name}") for name in ("all", "half")}, at, half)
    width = 4 * (ops.agg(F.floor(F.max("trx_no") / 3) + 1).first()[0] or 1)  # parts end between transactions
    last = -1
    for k in range(3):
        ops.where((F.col("pos") >= k * width) & (F.col("pos") < (k + 1) * width)).write.mode("append").parquet(f"{at}/log")
        last = max(last, apply.run_available(apply.stream_table(spark, f"{at}/log"), sink, f"{at}/checkpoint"))
    return reduce(DataFrame.unionByName, (apply.snapshot(spark, f"{at}/{name}", last).withColumn("destination", F.lit(name)) for name in ("all", "half")))


@query("WITH {ops} SELECT server_uuid, max(trx_id) AS mark FROM trx GROUP BY server_uuid")
def stream_marks(spark: SparkSession, folder: str) -> DataFrame:
    ops = oplog.derived(apply.stream_table(spark, f"{folder}/events.parquet"))
    at = fresh_folder(spark, "stream")
    last = apply.run_available(ops, apply.apply_to(at, skip_applied=True), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/marks/v={last}")


@query(_FOLD + " SELECT db, tab, pk, value, props FROM r WHERE n = 1 AND op <> 'delete'")
def stream_binlog(spark: SparkSession, folder: str) -> DataFrame:
    """Binary log files as a stream, decoded, what was applied before left out, folded."""
    at = fresh_folder(spark, "stream")
    _binlog_files(spark, folder).write.parquet(f"{at}/files")
    apply.in_order(spark, f"{at}/files")
    sink = apply.of_logs(apply.apply_to(f"{at}/table", skip_applied=True), "pk long, value double, props string")
    last = apply.run_available(apply.stream_table(spark, f"{at}/files"), sink, f"{at}/checkpoint")
    return apply.snapshot(spark, f"{at}/table", last)


@query(_FOLD + " SELECT db, tab, pk, props FROM r WHERE n = 1 AND op <> 'delete'")
def stream_text(spark: SparkSession, folder: str) -> DataFrame:
    """Textual log files as a stream, with the columns that their table maps name, what was applied before left out, folded."""
    at = fresh_folder(spark, "stream")
    # A file has what stands between two places of the log, and whole transactions.
    ops = oplog.read(spark, folder).repartitionByRange(F.floor(F.col("pos") / 4000)).sortWithinPartitions("pos")
    textlog.write(ops).select(F.concat(F.lit("# at "), "record").alias("value")).write.text(f"{at}/files")
    apply.in_order(spark, f"{at}/files")
    own = apply.apply_to(f"{at}/table", skip_applied=True)
    sink = apply.of_text(lambda ops, n: own(ops.withColumnRenamed("id", "pk").withColumn("value", F.lit(None).cast("double")), n), "id long, props string")
    last = apply.run_available(apply.stream_text(spark, f"{at}/files", files_at_once=3), sink, f"{at}/checkpoint")
    return apply.snapshot(spark, f"{at}/table", last).select("db", "tab", "pk", "props")
