"""The sliding maximum in two running ones against a plain scan."""

from __future__ import annotations

import random

import pytest

from tidewright.operators.series import with_sliding_max


@pytest.mark.parametrize("lookback", [1, 2, 7, 30, 200])
def test_sliding_maximum(spark, lookback):
    rnd = random.Random(lookback)
    values = {k: [rnd.choice([None, rnd.random(), 0.5]) if k else None for _ in range(90)] for k in range(4)}
    df = spark.createDataFrame([(k, i, v) for k, own in values.items() for i, v in enumerate(own)], "id int, idx int, close double")
    got = {(r["id"], r["idx"]): r["high"] for r in with_sliding_max(df, "close", lookback, "high").collect()}
    for k, own in values.items():
        for i in range(90):
            seen = [v for v in own[max(0, i - lookback + 1) : i + 1] if v is not None]
            assert got[k, i] == (max(seen) if seen else None)


def test_one_exchange_serves_it(spark):
    df = spark.range(1000).selectExpr("id % 10 as id", "cast(id / 10 as int) as idx", "cast(id as double) as close").repartition("id")
    plan = with_sliding_max(df, "close", 25, "high")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
