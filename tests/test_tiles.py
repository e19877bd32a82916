"""Covariances in tiles against numpy, whatever the tiles' size."""

from __future__ import annotations

import numpy as np
import pytest

from tidewright.operators import groups


def frame(spark, m, first=0):
    rows = [(k, first + d, float(v)) for k, series in enumerate(m) for d, v in enumerate(series)]
    return spark.createDataFrame(rows, "id long, idx int, ret double")


@pytest.mark.parametrize(("ids", "days"), [(3, 7), (1, 1), (256, 256)])
def test_products_do_not_depend_on_the_tiles(spark, ids, days):
    m = np.random.default_rng(1).normal(5.0, 0.01, (8, 30))  # a mean far from zero: raw sums would cancel
    got = {(r["i"], r["j"]): r for r in groups.cross_products(frame(spark, m, 3), ids, days).collect()}
    centred = m - m.mean(1, keepdims=True)
    want = centred @ centred.T
    assert sorted(got) == [(i, j) for i in range(8) for j in range(i, 8)]
    for (i, j), r in got.items():
        assert r["days"] == 30 and r["xy"] == pytest.approx(want[i, j], rel=1e-9, abs=1e-15)
        assert r["xx"] == pytest.approx(want[i, i], rel=1e-9) and r["yy"] == pytest.approx(want[j, j], rel=1e-9)


def test_more_series_than_a_tile_holds(spark):
    """600 series: three blocks, and rows only for blocks and days, not for pairs and days."""
    m = np.random.default_rng(2).normal(0, 0.01, (600, 20))
    out = groups.covariances(frame(spark, m))
    assert out.count() == 600 * 601 // 2
    some = {(r["i"], r["j"]): r["cov"] for r in out.where("i in (0, 255, 256) and j in (256, 599)").collect()}
    want = np.cov(m) * 252
    assert len(some) == 6 and all(v == pytest.approx(want[k]) for k, v in some.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" not in plan


def test_few_days_and_no_series(spark):
    one = frame(spark, np.array([[0.1], [0.2]]))
    assert [r["cov"] for r in groups.covariances(one).collect()] == [0.0] * 3
    assert [r["correlation"] for r in groups.correlations(one).collect()] == [None]
    assert groups.covariances(one.limit(0)).count() == 0 and groups.average_correlation(one.limit(0)).first()["correlation"] is None
