"""SQL over a cache and a published version: which files a filter leaves, and the stream into a cache."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewright.sources import catalog, sinks, stores
from tidewright.streaming import refresh

DAY = dt.date(2020, 1, 1)


def points(spark, ids, days, close=1.0):
    return spark.createDataFrame([(f"s{i}", DAY + dt.timedelta(d), close + d) for i in ids for d in days], "id string, date date, close double")


def files_read(df):
    """How many files the scans of a query that has run opened."""
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().iterator()
    n = 0
    while metrics.hasNext():
        found = metrics.next().metrics().get("numFiles")
        n += found.get().value() if found.isDefined() else 0
    return n


def test_sql_over_a_cache(spark, tmp_path):
    store = stores.PriceStore(spark, f"file://{tmp_path}/c", target_rows=20)
    store.write(points(spark, range(60), range(5)))
    assert catalog.register(spark, store, prefix="t_") == ["t_closes"]
    found = spark.sql("select id, date, close from t_closes where id = 's7' and date >= date'2020-01-04'")
    assert sorted(map(tuple, found.collect())) == [("s7", DAY + dt.timedelta(d), 1.0 + d) for d in (3, 4)]
    # The same view for two branches and once more for all: no filter of another query is left.
    both = spark.sql("select count(*) as n from t_closes where id = 's7' union all select count(*) from t_closes where id in ('s8', 's9')")
    assert [r["n"] for r in both.collect()] == [5, 10] and spark.table("t_closes").count() == 300
    row = spark.sql("select range_position(3D, 1D, 5D) as a, range_position(1D, 1D, 1D) as b, annualised(0.1D, 252D) as c").first()
    assert (row["a"], row["b"]) == (50.0, None) and row["c"] == pytest.approx(0.1)


def test_one_series_opens_one_partition(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    panel = spark.createDataFrame([(f"s{i}", d, 1.0) for i in range(200) for d in range(2)], "id string, idx int, close double")
    sinks.publish(spark.createDataFrame([("s1", 1.0)], "id string, ret double"), panel, spark.createDataFrame([("x",)], "as_of string"), root)
    catalog.register(spark, site=root, prefix="p_")
    one = spark.sql("select idx, close from p_series_of('s7')")
    assert sorted(map(tuple, one.collect())) == [(0, 1.0), (1, 1.0)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert files_read(spark.sql("select * from p_series_of('s7')")) == 1 and files_read(spark.table("p_series")) > 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_views_of_a_published_version(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    panel = spark.createDataFrame([("s1", 0, None), ("s1", 1, 1.23456)], "id string, idx int, close double")
    sinks.publish(spark.createDataFrame([("s1", 1.0)], "id string, ret double"), panel, spark.createDataFrame([("x",)], "as_of string"), root)
    assert catalog.register(spark, site=root, prefix="v_") == ["v_manifest", "v_universe", "v_series"]
    assert [tuple(r) for r in spark.sql("select s.id, idx, close, ret from v_series s join v_universe using (id)").collect()] == [("s1", 1, 1.2346, 1.0)]


def test_a_stream_is_merged_into_a_cache(spark, tmp_path):
    store = stores.PriceStore(spark, f"file://{tmp_path}/c", target_rows=20)
    store.write(points(spark, range(40), range(3)))
    before = store.table().state()
    src = f"file://{tmp_path}/in"
    points(spark, [3], [2, 3], 50.0).coalesce(1).write.parquet(src)
    arriving = lambda: spark.readStream.schema("id string, date date, close double").parquet(src)
    refresh.cache_stream(arriving(), store, DAY, f"{tmp_path}/cp").awaitTermination(60)
    refresh.cache_stream(arriving(), store, DAY, f"{tmp_path}/cp2").awaitTermination(60)  # all of it once more
    got = {r["date"]: r["close"] for r in store.read(["s3"]).collect()}
    assert got == {DAY: 1.0, DAY + dt.timedelta(1): 2.0, DAY + dt.timedelta(2): 52.0, DAY + dt.timedelta(3): 53.0}
    assert all(len(d["gone"]) == 1 for d in store.table().deltas(before.version))
