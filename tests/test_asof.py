"""As-of joins against a plain search, with hot keys, ties, nulls and every number of ranges."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidewright.operators.asof import asof, micros


def plain(left, right, back, within=None):
    out = []
    for k, t, i in left:
        hits = [(rt, rs, ri) for rk, rt, rs, ri in right if rk == k and k is not None and t is not None and rt is not None and (rt <= t if back else rt >= t)]
        best = (max if back else min)(hits, default=None)
        if best and within is not None and abs((best[0] - t) / dt.timedelta(microseconds=1)) > within:
            best = None
        out.append((i, best[2] if best else None))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_nearest_rows(spark, direction, parts):
    rnd = random.Random(parts)
    t0 = dt.datetime(2024, 1, 1)
    time = lambda: rnd.choice([None, *[t0 + dt.timedelta(minutes=rnd.randrange(200)) for _ in range(15)]])
    who = lambda: rnd.choice([None, 1, 1, 1, 2, 3, 4])
    left = [(who(), time(), i) for i in range(250)]
    right = [(who(), time(), rnd.randrange(10**9), i) for i in range(80)]
    a = spark.createDataFrame(left, "user int, ts timestamp, i int")
    b = spark.createDataFrame(right, "user int, ts timestamp, seq int, j int")
    got = sorted((r["i"], r["match"]["j"] if r["match"] else None) for r in asof(a, b, "ts", ["user"], direction, ["seq"], parts=parts).collect())
    assert got == plain(left, right, direction == "backward")
    limit = 10 * 60 * 1_000_000
    got = sorted((r["i"], r["match"]["j"] if r["match"] else None) for r in asof(a, b, "ts", ["user"], direction, ["seq"], limit, parts=parts).collect())
    assert got == plain(left, right, direction == "backward", limit)


def test_odd_tables(spark):
    a = spark.createDataFrame([(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 5), 1)], "day date, match int")
    b = spark.createDataFrame([(dt.date(2024, 1, 1), 7)], "day date, x int")
    got = asof(a, b, "day", name="hit").collect()
    assert [(r["match"], r["hit"]["x"]) for r in got] == [(1, 7)] * 2
    assert [r["hit"] for r in asof(a, b.limit(0), "day", name="hit").collect()] == [None, None]
    assert asof(a.limit(0), b, "day", name="hit").count() == 0
    assert spark.range(1).select(micros(__import__("pyspark.sql.functions").sql.functions.lit(dt.date(1970, 1, 2)))).first()[0] == 86_400_000_000
    with pytest.raises(ValueError, match="direction"):
        asof(a, b, "day", direction="sideways")


def test_a_hot_key_is_many_groups(spark):
    """All rows have one key: no group of the window holds over a few times its share."""
    a = spark.range(20_000).selectExpr("1 as k", "timestamp_seconds(id) as ts", "id")
    b = spark.range(0, 20_000, 7).selectExpr("1 as k", "timestamp_seconds(id) as ts", "id as x")
    out = asof(a, b, "ts", ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k0#" in plan and "_range#" in plan.split("hashpartitioning(", 1)[1].split(")", 1)[0]
    assert out.where("match.x <> id - id % 7").count() == 0 and out.count() == 20_000
