"""Incremental refresh: last-wins and first-wins merges, fetch bounds, outcomes, tiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.series import usable
from tidewright.schema import EARNINGS_CHUNK_DAYS, EARNINGS_RETENTION_DAYS, FETCH_OVERLAP_DAYS


def last_wins(cached: DataFrame, fetched: DataFrame, retain_from: dt.date, seq: str | None = None) -> DataFrame:
    """(id, date, close): closes since ``retain_from``; on equal days the fetched one, of several the last by ``seq``.

    The winner of a day decides: if it is not usable, the day has no close. Without ``seq`` the days of
    one side must differ; should they not, the larger close wins.
    """
    turn = lambda df, n: df.where(F.col("date") >= F.lit(retain_from)).select(
        "id", "date", "close", F.struct(F.lit(n).alias("turn"), (F.col(seq) if seq and seq in df.columns else F.lit(None)).cast("decimal(38,0)").alias("seq"), "close").alias("order")
    )
    both = turn(cached, 0).unionByName(turn(fetched, 1))
    # One row a key after a map-side reduction.
    won = both.groupBy("id", "date").agg(F.max("order")["close"].alias("close"))
    return won.where(usable(F.col("close")))


def first_wins(existing: DataFrame, fetched: DataFrame, retain_from: dt.date, *, seq: str, keys: tuple[str, ...] = ("id", "date")) -> DataFrame:
    """Rows since ``retain_from``: what is there never changes, new keys are added; of new equal keys the first by ``seq``."""
    old = existing.where(F.col("date") >= F.lit(retain_from))
    new = fetched.where(F.col("date") >= F.lit(retain_from)).join(old.select(*keys), list(keys), "left_anti")
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*existing.columns), F.struct(seq)).alias("row"))
    return old.unionByName(first.select("row.*"))


def fetch_from(cached: DataFrame, cold_start: dt.date, overlap: int = FETCH_OVERLAP_DAYS) -> DataFrame:
    """(id, fetch_from): some calendar days before the last cached day, never before the cold start."""
    return cached.groupBy("id").agg(F.greatest(F.date_sub(F.max("date"), overlap), F.lit(cold_start)).alias("fetch_from"))


def outcomes(cached: DataFrame, fetched: DataFrame, merged: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(id, added, total, stale) of each id, and ``error`` if failed requests (id, error) are given.

    stale: nothing was fetched for an id with history. An id whose request failed keeps its history: it
    adds nothing, counts what was cached and is stale.
    """
    n = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0)
    joined = n(cached, "old").join(n(fetched, "new"), "id", "full").join(n(merged, "total"), "id", "full")
    old, new, total = (F.coalesce(c, zero) for c in ("old", "new", "total"))
    stale = (new == 0) & (old > 0)
    if failed is None:
        return joined.select("id", F.greatest(zero, total - old).alias("added"), total.alias("total"), stale.alias("stale"))
    joined = joined.join(failed.groupBy("id").agg(F.min(F.coalesce("error", F.lit(""))).alias("error")), "id", "full")
    lost = F.col("error").isNotNull()
    pick = lambda a, b, name: F.when(lost, a).otherwise(b).alias(name)
    return joined.select("id", pick(zero, F.greatest(zero, total - old), "added"), pick(old, total, "total"), pick(F.lit(True), stale, "stale"), "error")


def tiles(spark, start: dt.date, end: dt.date, days: int = EARNINGS_CHUNK_DAYS) -> DataFrame:  # noqa: ANN001
    """(start, end): the days from start to end in pieces of at most ``days``."""
    first = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr(f"interval {days} days"))).alias("start"))
    return first.select("start", F.least(F.date_add("start", days - 1), F.lit(end)).alias("end"))


def earnings_bounds(fetched_to: dt.date | None, today: dt.date) -> tuple[dt.date, dt.date]:
    """(retain from, fetch from): cold, or some days before what has been fetched."""
    retain = today - dt.timedelta(days=EARNINGS_RETENTION_DAYS)
    if fetched_to is None:
        return retain, retain
    return retain, max(fetched_to - dt.timedelta(days=FETCH_OVERLAP_DAYS), retain)
