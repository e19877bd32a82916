"""Competition ranks within a pool, rank changes, screens, top-1 slots and whole-dollar splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.registry import Metric, metric
from tidewright.operators.ordered import finite, free_names, numbered, ranked_by
from tidewright.schema import GICS_SECTORS
from tidewright.scratch import kept, local_table

#: Rows beside the visible ones.
OVERSCAN = 8


def rank_within(value: Column, by: Sequence[str], descending: bool = True) -> Column:
    """1, 2, 2, 4 over the rows with a value within the groups of ``by``; null elsewhere."""
    v = finite(value)
    order = v.desc() if descending else v.asc()
    return F.when(v.isNotNull(), F.rank().over(Window.partitionBy(*by, v.isNull()).orderBy(order)))


def ranked(df: DataFrame, value: str, descending: bool = True, key: str = "id") -> DataFrame:
    """The measured rows with ``rank``, their place in the whole table; equal values share one."""
    rows = kept(df.where(finite(F.col(value)).isNotNull()), "measured")
    return ranked_by(rows, [("rank", F.col(value), descending)], key)


def unranked(df: DataFrame, value: str) -> DataFrame:
    return df.where(finite(F.col(value)).isNull())


def rank_change(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change) of the keys in both: places climbed; positive is towards rank 1."""
    b, a = before.select(key, F.col("rank").alias("then")), after.select(key, F.col("rank").alias("now"))
    return b.join(a, key).select(key, (F.col("then") - F.col("now")).alias("change"))


@dataclass(frozen=True)
class Screen:
    metric_id: str = "12-1"
    segment: str | None = None
    sector: str | None = None
    watchlist_only: bool = False
    invert: bool = False
    query: str = ""


def screen_pool(universe: DataFrame, view: Screen, watchlist: Sequence | DataFrame = ()) -> DataFrame:
    """Rows that pass every filter. watchlist: ids, or a table with a column id."""
    df = universe
    if view.segment:
        df = df.where(F.col("segment") == view.segment)
    if view.sector:
        df = df.where(F.col("sector") == view.sector)
    if view.watchlist_only:
        df = df.join(watchlist.select("id"), "id", "left_semi") if isinstance(watchlist, DataFrame) else df.where(F.col("id").isin(*watchlist) if len(watchlist) else F.lit(False))
    text = view.query.strip().upper()
    if text:
        df = df.where(F.col("id").cast("string").contains(text) | F.upper("name").contains(text))
    return df


def screen(universe: DataFrame, view: Screen, watchlist: Sequence | DataFrame = ()) -> DataFrame:
    """(universe columns, rank, value, change): ranks within the filtered pool.

    The change is measured in the metric that the active one is based on, in its natural direction;
    a row without a value has rank 0 and no value.
    """
    active: Metric = metric(view.metric_id)
    basis = metric(active.based_on or active.id)
    df = kept(screen_pool(universe, view, watchlist), "pool")
    before = [("basis_now", basis.value, basis.descending), ("basis_then", basis.prior, basis.descending)]
    down = active.descending != view.invert
    if active.kind == "rank-change":
        df = ranked_by(df, before)
        df = kept(df.withColumn("change", F.col("basis_then") - F.col("basis_now")).withColumn("value", F.col("change").cast("double")), "changes")
        df = ranked_by(df, [("rank", F.col("value"), down)])
    else:
        own = [] if active is basis and down == basis.descending else [("rank", active.value, down)]
        df = ranked_by(df, [*before, *own])
        df = df.withColumn("change", F.col("basis_then") - F.col("basis_now")).withColumn("value", finite(active.value))
        df = df if own else df.withColumn("rank", F.col("basis_now"))
    df = df.withColumn("rank", F.coalesce("rank", F.lit(0)))
    return df.drop("basis_now", "basis_then")


def _slots(universe: DataFrame, a: str, b: str) -> DataFrame:
    by = ["segment", "sector"]
    both = universe.where(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull())
    return both.select(
        "*",
        ((rank_within(F.col(a), by) + rank_within(F.col(b), by)) / 2).alias("average_rank"),
        F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("of"),
    )


def leaders(universe: DataFrame, a: str = "ret_12_1", b: str = "ret_6_1") -> DataFrame:
    """The best row of each (segment, sector) by the mean of two ranks; ties: higher ``a``, then lower id."""
    w = Window.partitionBy("segment", "sector").orderBy(F.col("average_rank"), F.col(a).desc(), F.col("id"))
    return _slots(universe, a, b).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def empty_slots(universe: DataFrame, segments: Sequence[str], sectors: Sequence[str] = GICS_SECTORS, a: str = "ret_12_1", b: str = "ret_6_1") -> DataFrame:
    """(segment, sector) of the grid without a candidate."""
    grid = local_table(universe.sparkSession, {"segment": pa.array([s for s in segments for _ in sectors], pa.string()), "sector": pa.array([t for _ in segments for t in sectors], pa.string())})
    have = universe.where(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull()).select("segment", "sector").distinct()
    return grid.join(have, ["segment", "sector"], "left_anti")


def capped_per_segment(members: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids of each segment, by id."""
    w = Window.partitionBy("segment").orderBy("id")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def cash_amounts(weights: DataFrame, total: float, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """``amount``: whole dollars in proportion to ``weight`` that add up to the total exactly.

    Leftover dollars go to the largest fractions, then by ``order``. One group of weights is one portfolio: its
    sums are aggregates, and the places of its fractions are taken over ranges of all rows, so no group is
    one task.
    """
    mine, all_, exact, whole, left, place, first = free_names(weights, "_of", "_all", "_exact", "_whole", "_left", "_place", "_first")
    # A group is one value, equal for nulls too; it goes first in the order of the rows.
    df = weights.withColumn(mine, F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")))
    joined = lambda rows, sums: rows.join(sums.withColumnRenamed(mine, "_same"), F.col(mine).eqNullSafe(F.col("_same")), "left").drop("_same")
    df = joined(df, df.groupBy(mine).agg(F.sum("weight").alias(all_)))
    ok = (F.col(all_) > 0) & (F.col(all_) < float("inf")) & F.lit(total > 0)
    df = df.withColumn(exact, F.when(ok, F.col("weight") / F.when(F.col(all_) != 0, F.col(all_)) * total).otherwise(0.0)).withColumn(whole, F.floor(exact))
    df = numbered(df, [F.col(mine), (F.col(exact) - F.col(whole)).desc(), F.col(order)], place)
    sums = df.groupBy(mine).agg(F.floor(F.lit(total) - F.sum(whole) + 0.5).alias(left), F.min(place).alias(first))
    df = joined(df, sums)
    extra = F.when(ok & (F.col(place) - F.col(first) < F.col(left)), 1).otherwise(0)
    return df.withColumn("amount", (F.col(whole) + extra).cast("long")).drop(mine, all_, exact, whole, left, place, first)


def viewport(ranked_rows: DataFrame, first: int, shown: int, overscan: int = OVERSCAN) -> DataFrame:
    """The rows of a ranking that a list shows from place ``first`` (0-based) on, and some on both sides. Ties: by id."""
    low = max(0, first - overscan)
    return ranked_rows.orderBy("rank", "id").offset(low).limit(first + shown + overscan - low)


def in_list_order(universe: DataFrame, ids: Sequence) -> DataFrame:
    """The rows of ``ids`` with their place in the list; unknown ids are dropped."""
    places = local_table(universe.sparkSession, {"place": pa.array(range(len(ids)), pa.int32()), "id": pa.array(list(ids), None if len(ids) else pa.string())})
    return places.withColumn("id", F.col("id").cast(universe.schema["id"].dataType)).join(universe, "id").orderBy("place")
