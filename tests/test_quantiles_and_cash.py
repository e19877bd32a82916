"""Exact quantiles and whole-dollar splits without a task a group, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import groups, ranking
from tidewright.scratch import kept

WANTED = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.mark.parametrize("sketch", [40, 10_000])
def test_quantiles_equal_numpy(spark, sketch):
    rnd = random.Random(6)
    draw = {"a": lambda: rnd.gauss(0, 1), "b": lambda: rnd.choice([0.0, -0.0, 1.0, 1.0, 1.0]), None: lambda: rnd.choice([2.5, float("nan"), None]), "one": lambda: 7.0, "none": lambda: None}
    rows = [(k, draw[k](), i) for k, n in (("a", 700), ("b", 300), (None, 50), ("one", 1), ("none", 5)) for i in range(n)]
    df = kept(spark.createDataFrame(rows, "g string, v double, id int"), "t")
    got = {r["g"]: r["quantiles"] for r in groups.quantiles(df, "v", WANTED, ["g"], sketch).collect()}
    assert set(got) == {"a", "b", None, "one", "none"} and got["none"] is None
    for k in ("a", "b", None, "one"):
        own = [v for g, v, _ in rows if g == k and v is not None and v == v]
        assert got[k] == pytest.approx(np.quantile(own, WANTED))
    whole = groups.quantiles(df, "v", [0.5], (), sketch).first()["quantiles"]
    assert whole == pytest.approx([np.quantile([v for _, v, _ in rows if v is not None and v == v], 0.5)])
    assert groups.quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_a_group_is_not_collected(spark):
    """A million rows of one group: the rows that are sorted are those of the bracket."""
    df = kept(spark.range(1_000_000).select(F.lit("all").alias("g"), (F.xxhash64("id") / 2.0**63).alias("v"), "id"), "t")
    out = groups.quantiles(df, "v", [0.5], ["g"])
    got = out.first()["quantiles"][0]
    below, above = df.where(F.col("v") < got).count(), df.where(F.col("v") > got).count()
    assert below == above == 500_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def plain_cash(weights, total):
    s = sum(w for _, w in weights)
    exact = [w / s * total for _, w in weights] if s > 0 and total > 0 else [0.0] * len(weights)
    left = math.floor(total - sum(map(math.floor, exact)) + 0.5) if s > 0 and total > 0 else 0
    order = sorted(range(len(weights)), key=lambda i: (-(exact[i] - math.floor(exact[i])), weights[i][0]))
    extra = set(order[:left])
    return {weights[i][0]: math.floor(exact[i]) + (i in extra) for i in range(len(weights))}


def test_cash_of_many_groups(spark):
    rnd = random.Random(9)
    rows = [(f"p{k % 4}" if k % 5 else None, k, rnd.choice([1.0, 1.0, 2.0, rnd.random(), 0.0])) for k in range(400)]
    rows += [("zero", 1000 + k, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "segment string, id int, weight double")
    out = ranking.cash_amounts(df, 9_999, "id", ["segment"])
    assert out.columns == ["segment", "id", "weight", "amount"]
    got = {}
    for r in out.collect():
        got.setdefault(r["segment"], {})[r["id"]] = r["amount"]
    for segment in {r[0] for r in rows}:
        assert got[segment] == plain_cash([(i, w) for s, i, w in rows if s == segment], 9_999)
    assert sum(got["p1"].values()) == 9_999 and sum(got["zero"].values()) == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
