"""The batch refresh from answers to a published version, and the stores under it."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pytest

from tests.test_series import walk
from tidewright import schema
from tidewright.operators import membership
from tidewright.plans import refresh
from tidewright.scratch import local_table
from tidewright.sources import readers, sinks, stores

TODAY = dt.date(2026, 8, 19)
RAW = "symbol string, date string, epsActual string, epsEstimated string, revenueActual string, revenueEstimated string, seq long"


def weekdays(n, last=TODAY - dt.timedelta(1)):
    out = []
    while len(out) < n:
        if last.weekday() < 5:
            out.append(last)
        last -= dt.timedelta(1)
    return out[::-1]


def closes(spark, series):
    rows = [(k, d.isoformat(), str(c), i) for k, cs in series.items() for i, (d, c) in enumerate(zip(weekdays(len(cs)), cs, strict=True))]
    cols = list(zip(*rows, strict=True))
    return local_table(spark, dict(zip(("id", "date", "close", "seq"), map(pa.array, cols), strict=True)))


def answers(spark, days=860, failing=(), events=None):
    names = {"AAA": "500", "BBB": "400", "CCC": "600", "DDD": "500", "DDD-B": "500", "GONE": "400", "NIL": "600"}
    rows = [(seg, k.replace("-", "."), "Dee Inc (Class B)" if k == "DDD-B" else "Dee Inc" if k == "DDD" else f"{k} Co", "energy", None, i) for i, (k, seg) in enumerate(names.items())]
    rows.append(("600", "AAA", "Aaa Co", "energy", "Oil", 99))
    listed = spark.createDataFrame(rows, "segment string, symbol string, name string, sector string, subSector string, seq int")
    quotes = spark.createDataFrame([(k, k, "X", 1.0, float(i + 1), None, None, i) for i, k in enumerate(names)], "symbol string, name string, exchange string, price double, marketCap double, yearLow double, yearHigh double, seq int")
    data = {k: walk(3 + i, days, 0.02) for i, k in enumerate(["SPY", "IJH", "IJR", "AAA", "BBB", "CCC", "DDD", "DDD-B"]) if k not in failing}
    points = closes(spark, data)
    old = [(("GONE"), d.isoformat(), "5", i) for i, d in enumerate(weekdays(days)[: days - 40])]
    points = points.unionByName(spark.createDataFrame(old, "id string, date string, close string, seq long"))
    failed = spark.createDataFrame([(k, "status 500") for k in failing], "id string, error string")
    return refresh.Answers(listed, quotes, points, failed, events or (lambda a, b: spark.createDataFrame([("aaa", "2026-08-03", "2", "1", None, None, 1)], RAW)))


def test_a_run_publishes_and_a_failed_request_keeps_history(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    done = refresh.refresh(spark, answers(spark), root, TODAY, minimum=3)
    manifest, universe = readers.dataset(spark, f"{root}/site")
    rows = {r["id"]: r for r in universe.collect()}
    assert set(rows) == {"AAA", "BBB", "CCC", "DDD-B"}
    why = {r["id"]: r["reason"] for r in done.excluded.collect()}
    assert why["DDD"] == "same-company:DDD-B" and why["GONE"].startswith("stale:") and why["NIL"] == "no-history" and why["AAA"] == "listed-in:500"
    a = rows["AAA"]
    assert a["benchmark"] == "SPY" and a["sector"] == "Energy" and a["industry"] == "Unknown" and not a["stale"]
    assert a["returns"]["12_1"] is not None and a["prior"]["returns"]["12m"] is not None and a["history"]["days"] == 860
    assert a["earnings"]["date"] == dt.date(2026, 8, 3) and a["earnings"]["surprise"] is not None and rows["BBB"]["earnings"] is None
    assert manifest.first()["as_of"] == "2026-08-18"
    ask = {r["id"]: r["fetch_from"] for r in refresh.wanted(spark, universe.select("id"), root, TODAY).collect()}
    assert ask["AAA"] == dt.date(2026, 8, 11) and ask["SPY"] == dt.date(2026, 8, 11)

    def broken(start, end):
        raise OSError("no answer")

    again = refresh.refresh(spark, answers(spark, 10, failing=("BBB",), events=broken), root, TODAY, minimum=3)
    out = {r["id"]: r for r in again.outcomes.collect()}
    assert out["BBB"]["stale"] and out["BBB"]["error"] == "status 500" and out["BBB"]["total"] == 860 and not out["AAA"]["stale"]
    rows = {r["id"]: r for r in readers.dataset(spark, f"{root}/site")[1].collect()}
    assert rows["BBB"]["stale"] and rows["BBB"]["history"]["days"] == 860 and rows["AAA"]["earnings"] is not None


def test_nothing_is_published_with_errors(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    u, p, m = spark.createDataFrame([("A", 1.0)], "id string, ret double"), spark.createDataFrame([("A", 0, 1.0)], "id string, idx int, close double"), spark.createDataFrame([("x",)], "as_of string")
    issues = spark.createDataFrame([("warning", "all", "stale-above:10%"), ("error", "all", "rows-below:900")], "level string, subject string, issue string")
    with pytest.raises(ValueError, match="rows-below"):
        sinks.publish(u, p, m, root, issues)
    assert stores.current(spark, root) is None
    sinks.publish(u, p, m, root, issues.where("level = 'warning'"))
    assert stores.current(spark, root) is not None


def test_a_benchmark_with_too_little_history_stops_the_run(spark, tmp_path):
    with pytest.raises(ValueError, match="history"):
        refresh.refresh(spark, answers(spark, 100), f"file://{tmp_path}/short", TODAY, minimum=1)


def test_stores(spark, tmp_path):
    store = stores.PriceStore(spark, f"file://{tmp_path}/closes")
    assert store.read() is None and store.points().count() == 0
    rows = [(f"s{i}", dt.date(2020, 1, 1 + d), 1.0 * d + 1) for i in range(9) for d in range(3)]
    store.write(spark.createDataFrame(rows, store.schema))
    assert sorted(map(tuple, store.read().collect())) == sorted(rows)
    store.forget(spark.createDataFrame([("s1",), ("none",)], "id string"))
    assert {r["id"] for r in store.ids().collect()} == {f"s{i}" for i in range(9) if i != 1}
    stores.switch(spark, store.root, "v-lost")
    assert store.read() is None
    held = stores.EarningsStore(spark, f"file://{tmp_path}/events")
    assert held.read() is None
    asked = []

    def give(start, end):
        asked.append((start, end))
        return readers.earnings_between(spark.createDataFrame([("a", start.isoformat(), "1", "2", "x", None, 1)], RAW), start, end).withColumn("seq", __import__("pyspark.sql.functions").sql.functions.lit(1))

    to, found = held.refresh(TODAY, give)
    assert to == TODAY and found.count() == len(asked) == 16 and all((b - a).days < 14 for a, b in asked)
    asked.clear()
    to, found = held.refresh(TODAY + dt.timedelta(1), give)
    assert len(asked) == 1 and asked[0][0] == TODAY - dt.timedelta(7) and to == TODAY + dt.timedelta(1)
    at = stores.current(spark, held.root)
    stores.write_text(spark, f"{at}/state.json", "{}")
    assert held.read() is None


def test_series_open_only_their_partitions(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    panel = spark.createDataFrame([(f"s{i}", d, 1.0) for i in range(40) for d in range(2)], "id string, idx int, close double")
    sinks.publish(spark.createDataFrame([("s1", 1.0)], "id string, ret double"), panel, spark.createDataFrame([("x",)], "as_of string"), root)
    found = readers.series(spark, root, ["s7", "nobody"])
    assert [(r["id"], r["idx"]) for r in found.orderBy("idx").collect()] == [("s7", 0), ("s7", 1)]
    assert len(found.inputFiles()) > 2 and "PartitionFilters: [isnotnull(id_part" in found._jdf.queryExecution().toString() or "PartitionFilters: [id_part" in found._jdf.queryExecution().toString()


def test_gates_and_lookups(spark):
    many = spark.range(500).selectExpr("cast(id as string) as ticker")
    assert membership.first_sufficient([many.limit(3), many], "500").count() == 500
    with pytest.raises(ValueError, match="no source"):
        membership.first_sufficient([many.limit(3)], "500")
    bench = spark.createDataFrame([("SPY", 1.0)] * 5, "id string, close double")
    membership.require_history(bench, 5)
    with pytest.raises(ValueError, match="SPY"):
        membership.require_history(bench, 6)
    assert schema.benchmark_for("400") == "IJH" and schema.is_segment("600") and not schema.is_segment("700")
    with pytest.raises(ValueError, match="700"):
        schema.benchmark_for("700")
    none = spark.createDataFrame([], "asset string, symbol string, name string")
    assert readers.fund(None) is None and readers.fund(none) is None
