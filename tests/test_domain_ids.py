"""Transaction ids by domain, server and sequence."""

import random

from millrace.operators import domain_ids

IDS = "domain long, server_id long, seq long, pos long"


def test_parse_and_text(spark):
    said = spark.createDataFrame([("0-1-270, 1-2-5",), ("1-2",), ("4294967296-1-1",), ("1-1-99999999999999999999",), ("0-1-9223372036854775807",), ("",), (None,)], "gtid string")
    got = sorted(map(tuple, domain_ids.parse(said).select("domain", "server_id", "seq", "valid").collect()), key=repr)
    assert got == sorted([(0, 1, 270, True), (1, 2, 5, True), (0, 1, 2**63 - 1, True), *[(None, None, None, False)] * 4], key=repr)
    marks = spark.createDataFrame([(10, 1, 7), (2, 3, 9)], "domain long, server_id long, seq long")
    assert domain_ids.text(marks).first().gtid == "2-3-9,10-1-7"
    assert domain_ids.text(marks.limit(0)).first().gtid == ""


def test_one_order_a_domain_whichever_server(spark):
    rng = random.Random(1)
    sent = [(rng.randrange(3), rng.randrange(1, 4), rng.randrange(1, 40), pos) for pos in range(300)]
    top, last, want, turns = {}, {}, [], []
    for d, s, n, pos in sent:
        if n > top.get(d, 0):
            if d in last and last[d] != s:
                turns.append((d, pos, n, last[d], s))
            top[d], last[d] = n, s
            want.append((d, s, n, pos))
    df = spark.createDataFrame(sent, IDS)
    assert sorted(map(tuple, domain_ids.first_seen(df).select("domain", "server_id", "seq", "pos").collect())) == sorted(want)
    assert sorted(map(tuple, domain_ids.handovers(df).collect())) == sorted(turns)
    marks = spark.createDataFrame([(0, 1, 20)], "domain long, server_id long, seq long")
    assert domain_ids.start_after(df, marks).count() == sum(d != 0 or n > 20 for d, _, n, _ in sent)


def test_high_water_and_gaps(spark):
    df = spark.createDataFrame([(0, 5, 3, 1), (0, 2, 3, 2), (0, 9, 1, 3), (1, 1, 1, 4), (1, 2, 5, 5)], IDS)
    assert sorted(map(tuple, domain_ids.high_water(df).collect())) == [(0, 2, 3), (1, 2, 5)]
    assert sorted(map(tuple, domain_ids.gaps(df).collect())) == [(0, 2, 2), (1, 2, 4)]
    assert domain_ids.high_water(df.limit(0)).count() == 0
