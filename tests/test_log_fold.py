"""A stream of changes and statements against a replay, over many cuts; stopped in the middle; rows that come late."""

import random

import pytest

from millrace.streaming import apply, log_fold

KIND = "pos long, kind string, op string, db string, tab string, pk long, value double, props string, new_db string, new_tab string"


def log_of(seed, n=160):
    unit = random.Random(seed)
    out = []
    for pos in range(n):
        tab = unit.choice("abc")
        kind = unit.choice(["row"] * 9 + ["ddl_rename_table", "ddl_truncate_table", "ddl_drop_table", "ddl_drop_database"])
        if kind == "row":
            out.append((pos, kind, unit.choice(["insert", "update", "delete"]), "s", tab, unit.randrange(4), float(pos), None, None, None))
        else:
            to = unit.choice("abcde")
            rename = kind == "ddl_rename_table"
            out.append((pos, kind, None, "s" if kind != "ddl_drop_database" or unit.random() < 0.3 else "other", None if kind == "ddl_drop_database" else tab, None, None, None, "s" if rename else None, to if rename else None))
    return out


def replay(log):
    tables = {}
    for _, kind, op, db, tab, pk, value, _, _, to in log:
        if kind == "row":
            own = tables.setdefault((db, tab), {})
            own.pop(pk, None) if op == "delete" else own.__setitem__(pk, value)
        elif kind == "ddl_rename_table":
            moved = tables.pop((db, tab), {})
            if to != tab:
                tables[db, to] = {**tables.get((db, to), {}), **moved}
            else:
                tables[db, tab] = moved
        elif kind == "ddl_drop_database":
            tables = {k: v for k, v in tables.items() if k[0] != db}
        else:
            tables.pop((db, tab), None)
    return {(*k, pk): v for k, own in tables.items() for pk, v in own.items()}


def valid(log):
    """The log without renames onto a table that is there, which a server refuses."""
    there, out = set(), []
    for row in log:
        _, kind, _, db, tab, _, _, _, _, to = row
        if kind == "ddl_rename_table":
            if tab not in there or to in there:
                continue
            there = there - {tab} | {to}
        elif kind == "ddl_drop_database":
            there = set() if db == "s" else there
        elif kind == "ddl_drop_table":
            there -= {tab}
        elif kind == "row":
            there |= {tab}
        out.append(row)
    return out


def table(spark, at, number, every):
    return {(r.db, r.tab, r.pk): r.value for r in log_fold.snapshot(spark, at, number, every).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_against_a_replay(spark, tmp_path, seed):
    log, unit = valid(log_of(seed)), random.Random(seed)
    cuts = sorted(unit.sample(range(1, len(log)), 4))
    sink = log_fold.apply_log(str(tmp_path), 3)
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(log)], strict=True)):
        sink(spark.createDataFrame(log[a:b], KIND), n)
        assert table(spark, str(tmp_path), n, 3) == replay(log[:b])


def test_stopped_before_the_mark_and_run_again(spark, tmp_path, monkeypatch):
    log = valid(log_of(7, 60))
    source, at = str(tmp_path / "log"), str(tmp_path / "table")
    whole = log_fold.apply_log(at, 2)

    def cut_short(batch, number):
        whole(batch, number)
        if number == 1:
            spark.createDataFrame([], "end long").write.mode("overwrite").parquet(f"{at}/marks/v=1")  # as if never written
            raise RuntimeError("lost")

    spark.createDataFrame(log[:30], KIND).coalesce(1).write.mode("append").parquet(source)
    assert apply.run_available(apply.stream_table(spark, source), cut_short, str(tmp_path / "c")) == 0
    spark.createDataFrame(log[30:], KIND).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        apply.run_available(apply.stream_table(spark, source), cut_short, str(tmp_path / "c"))
    assert apply.run_available(apply.stream_table(spark, source), whole, str(tmp_path / "c")) == 1
    assert table(spark, at, 1, 2) == replay(log)


def test_late_rows_are_reported(spark, tmp_path):
    log = valid(log_of(4, 40))
    sink = log_fold.apply_log(str(tmp_path))
    sink(spark.createDataFrame(log[:30], KIND), 0)
    sink(spark.createDataFrame(log[25:], KIND), 1)
    sink(spark.createDataFrame([], KIND), 2)
    assert table(spark, str(tmp_path), 2, 20) == replay(log)
    assert sorted((r.pos, r.batch) for r in log_fold.late(spark, str(tmp_path), 2).collect()) == [(r[0], 1) for r in log[25:30]]
