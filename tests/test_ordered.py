"""Places and ranks over ranges against plain sorts: ties, frequent values, rows without a value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ordered, ranking
from tidewright.scratch import kept


def plain_ranks(values, descending):
    known = sorted((v for v in values if v is not None and v == v and abs(v) != float("inf")), reverse=descending)
    first = {}
    for i, v in enumerate(known):
        first.setdefault(v, i + 1)
    return [first.get(v) for v in values]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kind", ["ties", "distinct", "one value", "none"])
def test_ranks_equal_a_plain_sort(spark, kind, descending):
    rnd = random.Random(3)
    draw = {
        "ties": lambda: rnd.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1.5, 1.5, 1.5, 1.5, rnd.gauss(0, 1), rnd.randrange(5) / 1.0]),
        "distinct": lambda: rnd.random(),
        "one value": lambda: 2.0,
        "none": lambda: None,
    }[kind]
    values = [draw() for _ in range(700)]
    df = kept(spark.createDataFrame(list(enumerate(values)), "id int, v double"), "t").withColumn("_b0", F.lit(7))
    got = {r["id"]: (r["rank"], r["_b0"]) for r in ordered.ranked_by(df, [("rank", F.col("v"), descending)]).collect()}
    assert [got[i] for i in range(700)] == [(r, 7) for r in plain_ranks(values, descending)]


def test_several_ranks_at_once(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(9) / 2, rnd.gauss(0, 1) if i % 4 else None) for i in range(500)]
    df = kept(spark.createDataFrame(rows, "id int, a double, b double"), "t")
    got = sorted((r["id"], r["ra"], r["rb"]) for r in ordered.ranked_by(df, [("ra", F.col("a"), True), ("rb", F.col("b"), False)]).collect())
    assert [(a, b) for _, a, b in got] == list(zip(plain_ranks([r[1] for r in rows], True), plain_ranks([r[2] for r in rows], False), strict=True))


def test_a_frequent_value_is_dealt_over_parts(spark):
    """Half of the rows are equal: no part of the window holds over a few times its share."""
    df = kept(spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 0.25).otherwise(F.rand(1)).alias("v")), "t")
    out = ordered.ranked_by(df, [("rank", F.col("v"), True)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_sub" in plan
    assert out.where("v = 0.25").select("rank").distinct().count() == 1
    better = df.where("v > 0.25").count()
    assert out.where("v = 0.25").first()["rank"] == better + 1


def test_places_follow_the_order(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(20)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {r["id"]: r["place"] for r in ordered.numbered(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    assert ordered.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_screens_rank_without_a_task_that_sees_all(spark):
    u = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("500").alias("segment"), F.lit("Energy").alias("sector"), (F.col("id") % 50 / 7).alias("ret_12_1"), (F.col("id") % 30 / 9).alias("prior_ret_12_1"))
    for view in (ranking.Screen(), ranking.Screen(invert=True), ranking.Screen("rank-change")):
        out = ranking.screen(u, view)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "isnull(" not in plan.split("Window", 1)[1].split("\n", 1)[0]
        assert out.count() == 300
