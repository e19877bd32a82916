"""Panels of aligned series: calendar, densifying join, as-of endpoints, daily returns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.asof import FORWARD, asof
from tidewright.schema import TOLERANCE
from tidewright.scratch import local_table

#: Rows of the dense panel that a part of it has, about.
DENSE_ROWS = 1 << 16


def usable(c: Column) -> Column:
    """Finite and above zero; false for null."""
    return F.coalesce(~F.isnan(c) & (c > 0) & (c < float("inf")), F.lit(False))


def clean(obs: DataFrame, unique: bool = False) -> DataFrame:
    """(id, date, close) with one usable close a day; of equal days the later by ``seq`` (if a column) wins.

    unique: the days of an id are known to differ, so nothing is exchanged.
    """
    good = obs.where(usable(F.col("close")))
    if unique:
        return good.select("id", "date", "close")
    if "seq" not in obs.columns:
        return good.groupBy("id", "date").agg(F.max("close").alias("close"))
    return good.groupBy("id", "date").agg(F.max_by("close", "seq").alias("close"))


def calendar_table(spark: SparkSession, dates: Sequence[dt.date]) -> DataFrame:
    """(idx, date) as literal rows, from the trading days in order."""
    return local_table(spark, {"idx": pa.array(range(len(dates)), pa.int32()), "date": pa.array(list(dates), pa.date32())})


def trading_days(benchmark_obs: DataFrame) -> list[dt.date]:
    """The days on which any benchmark traded, in order: as many as a calendar has, on the driver."""
    return sorted(r["date"] for r in benchmark_obs.select("date").distinct().collect())


def calendar(benchmark_obs: DataFrame) -> DataFrame:
    """(idx, date): the days on which any benchmark traded, from 0. As long as a calendar: one task."""
    days = benchmark_obs.select("date").distinct()
    return days.select((F.row_number().over(Window.orderBy("date")) - 1).alias("idx"), "date")


def densify(obs: DataFrame, cal: DataFrame, days: int | None = None, ids: int | None = None) -> DataFrame:
    """(id, idx, close): every id on every calendar day, null where it has no observation.

    days: the calendar's length, if known. The calendar is broadcast if the optimiser knows its size.
    ids: about how many there are; else they are counted, so give written observations.

    Each observation also makes the empty days up to the next one (the first those before it too),
    so one exchange by id serves this and all windows after it. It deals as many parts as the dense
    rows ask for: by the size of the sparse ones that are exchanged, parts would be merged, and what a
    task sorts would grow with the table. Observations off the calendar are dropped; an id that has no
    other is null throughout.
    """
    days = cal.count() if days is None else days
    ids = obs.agg(F.approx_count_distinct("id")).first()[0] if ids is None else ids
    placed = obs.join(cal, "date", "left").select("id", F.col("idx").alias("own"), "close")
    placed = placed.repartition(max(1, -(-ids * days // DENSE_ROWS)), "id")
    w = Window.partitionBy("id").orderBy(F.col("own").asc_nulls_last())
    marked = placed.select("*", F.row_number().over(w).alias("place"), F.lead("own").over(w).alias("next"))
    first = F.when(F.col("place") == 1, 0).otherwise(F.col("own"))
    last = F.coalesce("next", F.lit(days)) - 1
    span = marked.where((F.col("own").isNotNull() | (F.col("place") == 1)) & F.lit(days > 0))
    filled = span.select("id", "own", "close", F.explode(F.sequence(first, last)).alias("idx"))
    return filled.select("id", "idx", F.when(F.col("idx") == F.col("own"), F.col("close")).alias("close"))


def orphans(obs: DataFrame, cal: DataFrame) -> DataFrame:
    """Observations on days that the calendar lacks."""
    return obs.join(cal.select("date"), "date", "left_anti")


def by_time(key: str = "id") -> Window:
    return Window.partitionBy(key).orderBy("idx")


def endpoint(key: str = "id", close: str = "close", tolerance: int = TOLERANCE) -> Column:
    """Struct (idx, close) of the latest close within ``tolerance`` days back; null if none."""
    point = F.when(F.col(close).isNotNull(), F.struct(F.col("idx").alias("idx"), F.col(close).alias("close")))
    return F.last(point, ignorenulls=True).over(by_time(key).rowsBetween(-tolerance, 0))


def daily_return(key: str = "id", close: str = "close") -> Column:
    """Null unless this day and the one before both have a close: a gap takes both of its returns."""
    before = F.lag(close).over(by_time(key))
    return F.col(close) / before - 1


def with_returns(panel: DataFrame, key: str = "id") -> DataFrame:
    return panel.withColumn("ret", daily_return(key)).withColumn("end", endpoint(key))


def next_days(spark: SparkSession, dates: Sequence[dt.date]) -> DataFrame:
    """(day, idx): for every day up to the last of the calendar ``dates``, the first of them on or after it.

    Literal rows, one a natural day from the first of the calendar on.
    """
    days, at = [], []
    for i, d in enumerate(dates):
        first = dates[i - 1] + dt.timedelta(1) if i else d
        own = [first + dt.timedelta(k) for k in range((d - first).days + 1)]
        days += own
        at += [i] * len(own)
    return local_table(spark, {"day": pa.array(days, pa.date32()), "idx": pa.array(at, pa.int32())})


def index_at_or_after(dates: DataFrame, cal: DataFrame) -> DataFrame:
    """(date, idx) for distinct ``dates``: the first calendar day on or after each; no row past the end."""
    found = asof(dates.select("date").distinct(), cal.select("date", "idx"), "date", direction=FORWARD)
    return found.where(F.col("match").isNotNull()).select("date", F.col("match.idx").alias("idx"))


def with_sliding_max(panel: DataFrame, value: str, lookback: int, name: str, key: str = "id") -> DataFrame:
    """The panel with the greatest value of the last ``lookback`` days, this one included; null if none has one.

    The days of an id are cut into blocks as long as the lookback: a window is the end of one block and the
    start of the next, so two running maxima and one lag serve it, and each day is read twice whatever
    the lookback is. Every id has every day from 0 on, as ``densify`` gives it; nothing is exchanged again.
    """
    blocks = panel.withColumn(f"_{name}_block", F.floor(F.col("idx") / lookback))
    within = Window.partitionBy(key, f"_{name}_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.withColumn(f"_{name}_end", F.max(value).over(within.orderBy(F.col("idx").desc())))
    starts = ends.withColumn(f"_{name}_start", F.max(value).over(within.orderBy("idx")))
    before = F.lag(f"_{name}_end", lookback - 1).over(by_time(key))
    return starts.withColumn(name, F.greatest(f"_{name}_start", before)).drop(f"_{name}_block", f"_{name}_end", f"_{name}_start")


def gap_segments(panel: DataFrame, max_gap: int = TOLERANCE) -> DataFrame:
    """(id, idx, close, segment_no): islands of closes whose distance is at most ``max_gap`` days."""
    seen = panel.where(F.col("close").isNotNull())
    w = by_time()
    jump = F.when(F.col("idx") - F.lag("idx").over(w) > max_gap, 1).otherwise(0)
    return seen.withColumn("jump", jump).withColumn("segment_no", F.sum("jump").over(w)).drop("jump")


def tail(panel: DataFrame, days: int) -> DataFrame:
    """The last ``days`` + 1 calendar points of each id."""
    last = F.max("idx").over(Window.partitionBy("id"))
    return panel.withColumn("last", last).where(F.col("idx") >= F.col("last") - days).drop("last")
