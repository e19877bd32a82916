"""The record of every security: aligned panel, measures at both anchors, announcement, nested form."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import earnings, measures, membership, series
from tidewright.schema import RANK_CHANGE_OFFSET, RANK_WINDOWS, VOLATILITY_WINDOWS, WINDOWS, slug

RETURNS = [f"ret_{slug(w)}" for w in WINDOWS]
RESIDUALS = [f"res_{slug(w)}" for w in WINDOWS]
VOLATILITIES = [f"vol_{slug(w)}" for w in VOLATILITY_WINDOWS]
RANK_VOLATILITIES = [f"rank_vol_{slug(w)}" for w in RANK_WINDOWS]
RESIDUAL_VOLATILITIES = [f"res_vol_{slug(w)}" for w in RANK_WINDOWS]
OTHERS = [
    "return_per_vol", "max_drawdown", "beta", "alpha", "r2", "pairs", "last", "low52", "high52", "first_idx", "last_idx", "days",
    "from_high", "near_high", "positive_days", "downside", "top_days",
]
NOW = [*RETURNS, *RESIDUALS, *VOLATILITIES, *RANK_VOLATILITIES, *RESIDUAL_VOLATILITIES, *OTHERS]
PRIOR = [*RETURNS, *RESIDUALS, *VOLATILITIES, "return_per_vol"]

EVENT = [("date", "date"), ("eps_actual", "double"), ("eps_estimated", "double"), ("mark", "int"), ("mark_idx", "int"), ("mark_close", "double")]

#: Rows of benchmarks that the driver holds: segments times trading days.
MOST_BENCHMARK_DAYS = 1_000_000


@dataclass
class Aligned:
    """Securities and benchmarks on one calendar: lazy tables, and the trading days on the driver."""

    obs: DataFrame
    bench: DataFrame
    members: DataFrame
    dates: list[dt.date]
    cal: DataFrame
    panel: DataFrame
    days: DataFrame

    @property
    def anchor(self) -> int:
        return len(self.dates) - 1

    @property
    def anchors(self) -> list[tuple[str, int]]:
        return [("now", self.anchor), ("prior", self.anchor - RANK_CHANGE_OFFSET)]


def align(obs: DataFrame, bench: DataFrame, members: DataFrame) -> Aligned:
    """Clean observations (id, date, close) of securities and benchmarks on the benchmarks' days.

    bench: ids are segments. Its rows, one a segment and trading day, go to the driver once and come back
    as literal rows: so the calendar is known, no plan computes them again, and the optimiser broadcasts
    them by their known size. More than MOST_BENCHMARK_DAYS are an error.
    """
    spark = obs.sparkSession
    held = bench.limit(MOST_BENCHMARK_DAYS + 1).toArrow()
    if held.num_rows > MOST_BENCHMARK_DAYS:
        raise ValueError(f"more than {MOST_BENCHMARK_DAYS} days of benchmarks")
    bench = spark.createDataFrame(held)
    dates = sorted(set(held["date"].to_pylist()))
    cal = series.calendar_table(spark, dates)
    panel = series.densify(obs, cal, len(dates))
    own = measures.benchmark_panel(series.densify(bench, cal, len(dates), len(set(held["id"].to_pylist()))))
    return Aligned(obs, bench, members, dates, cal, panel, measures.panel_with_benchmarks(panel, members, own))


def records(a: Aligned, events: DataFrame | None) -> DataFrame:
    """One row a security with observations; ``prior_`` columns stand at the earlier anchor.

    One pass over the panel gives the measures, the as-of closes at both anchors and at the latest
    announcement; without ``events`` its columns are null. Securities without observations are those of
    ``excluded``.
    """
    if events is None:
        rows = measures.measured(a.days, a.anchors)
        ends = [F.expr(f"cast(null as {t}) as {c}") for c, t in EVENT]
        wide = measures.side_by_side(rows, [*NOW, "end_close", "end_idx"], [*PRIOR, "end_close"]).select("*", *ends)
    else:
        placed = earnings.placed(events, a.dates)
        rows = measures.measured(a.days.join(placed.select("id", "mark"), "id", "left"), a.anchors, "mark")
        wide = measures.side_by_side(rows, [*NOW, "end_close", "end_idx", "mark_close", "mark_idx"], [*PRIOR, "end_close"]).join(placed, "id", "left")
    joined = wide.join(a.members.select("id", "name", "sector", "market_cap"), "id")
    joined = membership.market_cap_back_cast(joined.withColumnsRenamed({"end_close": "end_now", "prior_end_close": "end_prior"}))
    joined = joined.withColumnsRenamed({"end_now": "end_close"})
    since = earnings.since_return(a.anchor)
    return joined.select(
        "id", "name", "segment", "sector", "market_cap", "prior_market_cap", *NOW, *[f"prior_{c}" for c in PRIOR],
        F.col("date").alias("event_date"), "eps_actual", "eps_estimated", earnings.surprise().alias("surprise"), since.alias("since_return"),
    )


def excluded(a: Aligned) -> DataFrame:
    """(id, reason) of the members without a close on the calendar."""
    seen = a.obs.join(a.cal.select("date"), "date", "left_semi").select("id").distinct()
    return a.members.join(seen, "id", "left_anti").select("id", F.lit("no-history").alias("reason"))


def dated(rows: DataFrame, a: Aligned, columns: Sequence[str] = ("first_idx", "last_idx")) -> DataFrame:
    """``rows`` with the calendar's date for each index column, as first_date for first_idx."""
    for c in columns:
        at = a.cal.select(F.col("idx").alias(c), F.col("date").alias(c.replace("idx", "date")))
        rows = rows.join(at, c, "left")
    return rows


def _by_window(stem: str, windows: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"{stem}_{slug(w)}").alias(slug(w)) for w in windows])


def nested(rows: DataFrame) -> DataFrame:
    """The record as it is published: metrics in groups, the history with its dates, and the block of the earlier anchor.

    rows: ``dated`` records with industry, benchmark and stale.
    """
    history = F.struct(F.col("days"), F.col("first_date").alias("from"), F.col("last_date").alias("to"))
    prior = F.struct(
        _by_window("prior_ret", list(WINDOWS)).alias("returns"), _by_window("prior_res", list(WINDOWS)).alias("residuals"),
        _by_window("prior_vol", list(VOLATILITY_WINDOWS)).alias("volatility"), F.col("prior_return_per_vol").alias("return_per_vol"), F.col("prior_market_cap").alias("market_cap"),
    )
    event = F.when(F.col("event_date").isNotNull(), F.struct(F.col("event_date").alias("date"), "eps_actual", "eps_estimated", "surprise", "since_return"))
    return rows.select(
        "id", "name", "segment", "benchmark", F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.coalesce("industry", F.lit("Unknown")).alias("industry"), "market_cap",
        _by_window("ret", list(WINDOWS)).alias("returns"), _by_window("res", list(WINDOWS)).alias("residuals"), _by_window("vol", list(VOLATILITY_WINDOWS)).alias("volatility"),
        _by_window("rank_vol", RANK_WINDOWS).alias("rank_volatility"), _by_window("res_vol", RANK_WINDOWS).alias("residual_volatility"),
        "return_per_vol", "max_drawdown", "beta", "r2", "pairs", "last", F.col("last_date"), "low52", "high52", event.alias("earnings"), history.alias("history"), prior.alias("prior"),
        F.coalesce("stale", F.lit(False)).alias("stale"),
    )
