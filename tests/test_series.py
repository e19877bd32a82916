"""Closed forms of the panel and its measures."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.operators import measures, series
from tidewright.sources import adapters

DAY = dt.date(2020, 1, 1)


def panel(spark, closes, segment="500"):
    """id -> list of closes, as (id, segment, idx, close)."""
    rows = [(k, segment, i, None if c is None else float(c)) for k, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "id string, segment string, idx int, close double")


def measure(spark, closes, bench, anchor=None):
    p = panel(spark, closes)
    b = panel(spark, {"500": bench}).select("id", "idx", "close")
    members = p.select("id", "segment").distinct()
    rows = measures.panel_with_benchmarks(p.select("id", "idx", "close"), members, measures.benchmark_panel(b))
    return {r["id"]: r for r in measures.measured(rows, [("now", anchor if anchor is not None else len(bench) - 1)]).collect()}


def compounding(days, rate, start=100.0):
    return [start * (1 + rate) ** i for i in range(days)]


def walk(seed, days, vol=0.02, drift=0.0004):
    s, out = float(seed), [100.0]
    for _ in range(days - 1):
        s = math.fmod(s * 1103515245 + 12345, 2**31)
        out.append(out[-1] * (1 + drift + (s / 2**31 - 0.5) * vol))
    return out


def test_endpoint_looks_back_five_days_and_never_forward(spark):
    p = panel(spark, {"a": [10, None, None, None, None, None, None, 17]})
    got = {r["idx"]: r["end"] for r in series.with_returns(p).collect()}
    assert got[5]["close"] == 10 and got[6] is None and got[7]["close"] == 17


def test_a_gap_takes_both_returns(spark):
    p = panel(spark, {"a": [100, 110, None, 121, 133.1]})
    got = [r["ret"] for r in series.with_returns(p).orderBy("idx").collect()]
    assert got[0] is None and got[1] == pytest.approx(0.1) and got[2] is None and got[3] is None and got[4] == pytest.approx(0.1)


def test_window_return_closed_form_and_minimum_history(spark):
    r = measure(spark, {"a": compounding(300, 0.001), "b": [None] * 26 + compounding(274, 0.001), "c": [None] * 33 + compounding(267, 0.001)}, compounding(300, 0.0005))
    assert r["a"]["ret_12_1"] == pytest.approx(1.001**252 - 1)
    assert r["b"]["ret_12_1"] is not None and r["c"]["ret_12_1"] is None
    short = measure(spark, {"a": compounding(273, 0.001)}, compounding(273, 0.0005))
    exact = measure(spark, {"a": compounding(274, 0.001)}, compounding(274, 0.0005))
    assert short["a"]["ret_12_1"] is None and exact["a"]["ret_12_1"] is not None


def test_volatility_of_alternating_returns_and_coverage(spark):
    closes = [100.0]
    for i in range(299):
        closes.append(closes[-1] * (1.01 if i % 2 == 0 else 0.99))
    sparse = [c if i % 3 == 0 else None for i, c in enumerate(closes)]
    r = measure(spark, {"a": closes, "b": sparse}, compounding(300, 0.001))
    assert r["a"]["vol_1y"] == pytest.approx(0.01 * math.sqrt(252 / 251) * math.sqrt(252), rel=1e-6)
    assert r["b"]["vol_1y"] is None


def test_drawdown_and_high(spark):
    r = measure(spark, {"a": [100] * 100 + [60] * 100 + [80] * 53}, compounding(253, 0.001))
    assert r["a"]["max_drawdown"] == pytest.approx(-0.4)
    assert r["a"]["from_high"] == pytest.approx(0.8)
    assert r["a"]["low52"] == 60 and r["a"]["high52"] == 100


def test_time_near_high(spark):
    r = measure(spark, {"a": [340] * 200 + [340] * 250 + [180] * 23 + [340] * 40}, compounding(513, 0.001))
    assert r["a"]["near_high"] == pytest.approx(40 / 63)


def test_planted_beta_alpha_and_residual(spark):
    bench = walk(7, 400)
    stock = [50.0]
    for a, b in zip(bench, bench[1:], strict=False):
        stock.append(stock[-1] * (1 + 2e-4 + 1.4 * (b / a - 1)))
    r = measure(spark, {"a": stock, "flat": [10.0] * 400}, bench)
    assert r["a"]["beta"] == pytest.approx(1.4) and r["a"]["alpha"] == pytest.approx(2e-4) and r["a"]["r2"] == pytest.approx(1)
    assert r["a"]["res_12_1"] == pytest.approx(r["a"]["ret_12_1"] - 1.4 * r["a"]["bret_12_1"])
    assert r["a"]["res_vol_12_1"] == pytest.approx(0, abs=1e-10)
    assert r["flat"]["r2"] == 0


def test_too_few_pairs_or_a_flat_benchmark_have_no_beta(spark):
    assert measure(spark, {"a": walk(3, 110)}, walk(5, 110))["a"]["beta"] is None
    assert measure(spark, {"a": walk(3, 300)}, [100.0] * 300)["a"]["beta"] is None


def test_path_quality(spark):
    r = measure(spark, {"up": compounding(300, 0.001), "down": compounding(300, -0.001)}, compounding(300, 0.0005))
    assert r["up"]["positive_days"] == 1 and r["up"]["downside"] == 0
    assert r["up"]["top_days"] == pytest.approx(5 / 252)
    assert r["down"]["top_days"] is None and r["down"]["positive_days"] == 0
    assert r["down"]["downside"] == pytest.approx(0.001 * math.sqrt(252))


def test_densify_uses_the_benchmark_calendar_and_counts_orphans(spark):
    days = [DAY + dt.timedelta(n) for n in range(3)]
    cal = series.calendar(spark.createDataFrame([("B", d, 1.0) for d in days], "id string, date date, close double"))
    obs = spark.createDataFrame([("a", days[0], 5.0), ("a", DAY + dt.timedelta(30), 6.0), ("a", days[2], float("nan"))], "id string, date date, close double")
    got = series.densify(series.clean(obs), cal).orderBy("idx").collect()
    assert [r["close"] for r in got] == [5.0, None, None]
    assert series.orphans(series.clean(obs), cal).count() == 1


def test_forward_index(spark):
    cal = spark.createDataFrame([(0, DAY), (1, DAY + dt.timedelta(3)), (2, DAY + dt.timedelta(4))], "idx int, date date")
    dates = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(1),), (DAY + dt.timedelta(4),), (DAY + dt.timedelta(9),)], "date date")
    got = {(r["date"] - DAY).days: r["idx"] for r in series.index_at_or_after(dates, cal).collect()}
    assert got == {0: 0, 1: 1, 4: 2}


def test_a_segment_without_benchmark_is_an_error(spark):
    p = panel(spark, {"a": [1, 2, 3]}, "999")
    b = measures.benchmark_panel(panel(spark, {"500": [1, 2, 3]}).select("id", "idx", "close"))
    rows = measures.panel_with_benchmarks(p.select("id", "idx", "close"), p.select("id", "segment").distinct(), b)
    with pytest.raises(Exception, match="no benchmark for segment 999"):
        rows.collect()


def test_a_query_reads_lineitem_once_or_twice(spark):
    import os

    from tidewright.plans import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the small data set is not here")
    scans = lambda df: sum("lineitem" in f for f in df.inputFiles())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate#")
    flagship = queries.rank_12_1(spark, data)
    assert scans(flagship) == 0 and plan(flagship) == 0  # only the written weekly table
    assert scans(queries.universe(spark, data, events=True)) == 1


def test_annualise(spark):
    got = spark.range(1).select(measures.annualise(F.lit(0.1), F.lit(252)).alias("a"), measures.annualise(F.lit(-1.0), F.lit(5)).alias("b"), measures.annualise(F.lit(0.1), F.lit(0)).alias("c")).first()
    assert got["a"] == pytest.approx(0.1) and got["b"] is None and got["c"] is None


def test_endpoints_of_every_day_give_their_sqls_rows(spark):
    import os

    import duckdb
    import pytest

    from tidewright.plans.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the small data set is not here")
    db = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            db.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    want = db.sql(ORACLE_SQL["endpoints_every_day"])
    got = [tuple(r) for r in QUERIES["endpoints_every_day"](spark, data).select(*want.columns).collect()]
    assert {r[1] % 21 for r in got} == set(range(21))
    near = lambda rows: sorted([(*r[:3], None if r[3] is None else round(r[3], 5)) for r in rows], key=repr)
    assert near(got) == near(want.fetchall())


def test_parts_of_the_dense_panel_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(series, "DENSE_ROWS", 100, raising=False)
    most = []
    for ids in (40, 160):
        obs = spark.createDataFrame([(i, DAY, 1.0) for i in range(ids)], "id int, date date, close double")
        dense = series.densify(obs, series.calendar_table(spark, [DAY + dt.timedelta(k) for k in range(50)]), 50)
        sizes = [r["count"] for r in dense.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 50 * ids
        most.append(max(sizes))
    assert max(most) <= 600, most


def test_weeks_are_grouped_in_parts_that_follow_the_rows(spark, monkeypatch):
    """What a task groups stays as large when the table grows, and the sums are those of all rows."""
    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(adapters, "GROUPED_ROWS", 200, raising=False)
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    weeks = adapters.weekly(spark, data)
    parts = weeks.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > rows / 400 and max(r["count"] for r in parts) <= 400
    want = duckdb.sql(f"""select l_suppkey, date_trunc('week', l_shipdate)::date, sum(l_extendedprice::decimal(18,2)), sum(l_quantity::decimal(18,2))
        from '{data}/lineitem.parquet' group by all""").fetchall()
    assert sorted(tuple(r) for r in weeks.collect()) == sorted(want)
