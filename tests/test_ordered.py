"""Totals along an order give the same whatever the width of the buckets."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.ordered import with_previous, with_running


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_widths(spark, width):
    unit = random.Random(width)
    rows = [(k, unit.choice(["a", "b", None]), unit.choice([None, 1, 5, -2])) for k in unit.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    prev = {r.k: r.p for r in with_previous(df, "k", F.col("v"), "p", ["g"], width).collect()}
    run = {r.k: (r.s, r.m, r.b) for r in with_running(with_running(with_running(df, "k", F.col("v"), "s", ["g"], width=width), "k", F.col("v"), "m", ["g"], "max", width=width), "k", F.col("v"), "b", None, "sum", True, width).collect()}
    last, total, most, all_ = {}, {}, {}, 0
    for k, g, v in sorted(rows, key=lambda r: r[0]):
        assert prev[k] == last.get(g)
        last[g] = v
        total[g] = total.get(g, 0) + (v or 0)
        most[g] = v if most.get(g) is None else most[g] if v is None else max(v, most[g])
        assert run[k] == (total[g], most[g], all_)
        all_ += v or 0
