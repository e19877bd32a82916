"""Statistics of each series at common anchors: returns, volatility, beta, residuals, path quality.

One hash partitioning by id serves the lags, as-of endpoints, rolling and running extremes, the
regression and the final aggregation: each id's days are exploded by its (two) anchors, beta is a
window over (id, anchor), and everything else is a conditional aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.series import with_returns, with_sliding_max
from tidewright.schema import (
    ANNUAL_DAYS,
    BETA_LOOKBACK,
    COVERAGE,
    DRAWDOWN_LOOKBACK,
    MIN_REGRESSION_OBS,
    RANGE_LOOKBACK,
    RANK_WINDOWS,
    VOLATILITY_WINDOWS,
    WINDOWS,
    slug,
)

ROOT = math.sqrt(ANNUAL_DAYS)
#: Path-quality settings: (lookback, recent days, band) and the number of best days.
HIGH_LOOKBACK, RECENT, BAND, BEST_DAYS = 252, 63, 0.05, 5


def benchmark_panel(bench: DataFrame) -> DataFrame:
    """(segment, idx, bret, bend): returns and as-of closes of the benchmarks' (id, idx, close)."""
    b = with_returns(bench.select(F.col("id").alias("segment"), "idx", "close"), "segment")
    return b.select("segment", "idx", F.col("ret").alias("bret"), F.col("end").alias("bend"))


def panel_with_benchmarks(panel: DataFrame, members: DataFrame, bench: DataFrame) -> DataFrame:
    """(id, segment, idx, close, ret, end, high, bret, bend): each day beside its segment's benchmark.

    bench: of ``benchmark_panel``, broadcast if the optimiser knows that it is small. A segment
    without a benchmark is an error.
    """
    own = with_sliding_max(panel.join(members.select("id", "segment"), "id"), "close", HIGH_LOOKBACK, "high")
    joined = with_returns(own).join(bench.withColumn("known", F.lit(True)), ["segment", "idx"], "left")
    unknown = F.raise_error(F.concat(F.lit("no benchmark for segment "), F.coalesce("segment", F.lit("null"))))
    return joined.withColumn("bret", F.when(F.col("known").isNull(), unknown.cast("double")).otherwise(F.col("bret"))).drop("known")


def anchored(rows: DataFrame, anchors: Sequence[tuple[str, int]]) -> DataFrame:
    """Each row once for every anchor (name, index)."""
    each = ", ".join(f"named_struct('at', '{n}', 'anchor', {a})" for n, a in anchors)
    return rows.select("*", F.expr(f"inline(array({each})) as (at, anchor)"))


def regression(y: Column, x: Column, over: Window | None = None) -> dict[str, Column]:
    """Ordinary least squares of y on x with its guards; x and y are null off the sample."""

    def of(c: Column) -> Column:
        return c.over(over) if over is not None else c

    n, sxx, syy, sxy = (of(f(y, x)) for f in (F.regr_count, F.regr_sxx, F.regr_syy, F.regr_sxy))
    ok = (n >= MIN_REGRESSION_OBS) & (sxx > 1e-18)
    beta = F.when(ok, F.try_divide(sxy, sxx))
    r2 = F.when(syy <= 1e-18, 0.0).otherwise(F.try_divide(sxy * sxy, sxx * syy))
    return {
        "beta": beta,
        "alpha": F.when(ok, of(F.regr_avgy(y, x)) - F.try_divide(sxy, sxx) * of(F.regr_avgx(y, x))),
        "r2": F.when(ok, r2),
        "pairs": F.when(ok, n).otherwise(0),
    }


# Aggregates are written as SQL expressions over the columns of ``anchored`` rows: one call a measure.


def _at(index: str, value: str) -> str:
    """The value on one day."""
    return f"max(case when idx = {index} then {value} end)"


def _within(value: str, lookback: int, skip: int = 0) -> str:
    """The value on the days of a lookback that ends ``skip`` days before the anchor."""
    return f"case when idx between anchor - {lookback + skip - 1} and anchor - {skip} then {value} end"


def _enough(values: str, lookback: int) -> str:
    return f"count({values}) >= {math.ceil(COVERAGE * lookback)}"


def return_between(start: str, stop: str, end: str = "end") -> Column:
    """Ratio of the closes as of two calendar indices less one; null unless both are there and apart.

    Both look back a few days, never forward. start, stop: SQL expressions of one value an id.
    """
    points = f"{_at(stop, f'`{end}`.idx')} > {_at(start, f'`{end}`.idx')}"
    return F.expr(f"case when min({start}) >= 0 and min({stop}) > min({start}) and {points} then {_at(stop, f'`{end}`.close')} / {_at(start, f'`{end}`.close')} - 1 end")


def window_return(formation: int, skip: int, end: str = "end") -> Column:
    """Return over a formation that ends ``skip`` days before the anchor."""
    return return_between(f"anchor - {skip + formation}", f"anchor - {skip}", end)


def volatility(ret: str, lookback: int, skip: int = 0) -> Column:
    """Annualised sample deviation of the returns of the lookback, if enough of them are there."""
    r = _within(ret, lookback, skip)
    enough = f"first(anchor) - {skip + lookback - 1} >= 1 and {_enough(r, lookback)} and count({r}) >= 2"
    return F.expr(f"case when {enough} then stddev_samp({r}) * {ROOT!r} end")


def return_per_vol(ret: Column, vol: Column) -> Column:
    return F.when(vol > 1e-9, F.try_divide(ret, vol))


def annualise(ret: Column, days: Column) -> Column:
    return F.when((days > 0) & (1 + ret > 0), F.pow(1 + ret, F.try_divide(F.lit(float(ANNUAL_DAYS)), days)) - 1)


def max_drawdown(lookback: int = DRAWDOWN_LOOKBACK) -> Column:
    """Worst close against the running peak of lookback + 1 closes; ``peak`` is that running maximum."""
    fall = _within("close / peak - 1", lookback + 1)
    enough = f"first(anchor) - {lookback} >= 0 and count({fall}) >= {max(20, 0.5 * lookback)}"
    return F.expr(f"case when {enough} then least(0.0D, min({fall})) end")


def distance_from_high(lookback: int = HIGH_LOOKBACK) -> Column:
    """The close at the anchor itself (no tolerance) against the highest close."""
    own = _within("close", lookback)
    enough = f"first(anchor) - {lookback - 1} >= 0 and {_enough(own, lookback)}"
    return F.expr(f"case when {enough} then {_at('anchor', 'close')} / max({own}) end")


def time_near_high(lookback: int = HIGH_LOOKBACK, recent: int = RECENT, band: float = BAND) -> Column:
    """Share of recent days within ``band`` of their own rolling high (column ``high``)."""
    near = _within(f"case when close is not null then cast(close >= high * {1 - band!r}D as double) end", recent)
    enough = f"first(anchor) - {recent + lookback - 2} >= 0 and {_enough(near, recent)}"
    return F.expr(f"case when {enough} then avg({near}) end")


def _sample(lookback: int) -> tuple[str, str]:
    r = _within("ret", lookback)
    return r, f"first(anchor) - {lookback - 1} >= 1 and {_enough(r, lookback)}"


def positive_day_share(lookback: int = 252) -> Column:
    r, enough = _sample(lookback)
    return F.expr(f"case when {enough} then avg(cast({r} > 0 as double)) end")


def downside_deviation(lookback: int = 252) -> Column:
    r, enough = _sample(lookback)
    return F.expr(f"case when {enough} then sqrt(sum(case when {r} < 0 then ret * ret else 0.0D end) / count({r})) * {ROOT!r} end")


def top_day_concentration(lookback: int = 252, best: int = BEST_DAYS) -> Column:
    """Share of the total log return that the best days made; null if the total is not positive.

    ``place`` numbers the returns of the lookback, the largest first.
    """
    r, enough = _sample(lookback)
    total = f"sum(ln(1 + {r}))"
    won = f"sum(case when place <= {best} and {r} is not null then greatest(ln(1 + ret), 0.0D) else 0.0D end)"
    return F.expr(f"case when {enough} and count({r}) > {best} and {best} > 0 and {total} > 0 then try_divide({won}, {total}) end")


def measured(rows: DataFrame, anchors: Sequence[tuple[str, int]], mark: str | None = None) -> DataFrame:
    """One row for each (id, at) with every statistic. rows: of ``panel_with_benchmarks``.

    mark: a column with one calendar index an id; then (mark_idx, mark_close) is the as-of point there.
    """
    w = Window.partitionBy("id", "at")
    inside = F.expr(_within("close", DRAWDOWN_LOOKBACK + 1))
    each = anchored(rows, anchors).withColumn("peak", F.max(inside).over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    both = f"idx between greatest(1, anchor - {BETA_LOOKBACK - 1}) and anchor and ret is not null and bret is not null"
    y, x = (F.expr(f"case when {both} then {c} end") for c in ("ret", "bret"))
    fit = regression(y, x, w)
    each = each.select("*", *[c.alias(n) for n, c in fit.items()])
    # The residual of each day after beta: two passes, as a difference of variances would cancel.
    best = F.row_number().over(w.orderBy(F.expr(_sample(252)[0]).desc_nulls_last()))
    each = each.select("*", F.expr("ret - beta * bret").alias("residual"), best.alias("place"))
    aggs: dict[str, Column] = {n: F.first(n) for n in fit}
    for name, (formation, skip) in WINDOWS.items():
        aggs[f"ret_{slug(name)}"] = window_return(formation, skip)
        aggs[f"bret_{slug(name)}"] = window_return(formation, skip, "bend")
    for name, lookback in VOLATILITY_WINDOWS.items():
        aggs[f"vol_{slug(name)}"] = volatility("ret", lookback)
    for name in RANK_WINDOWS:
        formation, skip = WINDOWS[name]
        aggs[f"rank_vol_{slug(name)}"] = volatility("ret", formation, skip)
        aggs[f"res_vol_{slug(name)}"] = volatility("residual", formation, skip)
    own, seen = _within("close", RANGE_LOOKBACK), "case when close is not null then idx end"
    points = {"end": "anchor", **({"mark": mark} if mark else {})}
    aggs |= {
        "max_drawdown": max_drawdown(),
        "low52": F.expr(f"min({own})"),
        "high52": F.expr(f"max({own})"),
        "from_high": distance_from_high(),
        "near_high": time_near_high(),
        "positive_days": positive_day_share(),
        "downside": downside_deviation(),
        "top_days": top_day_concentration(),
        "last": F.expr(f"max_by(close, {seen})"),
        "first_idx": F.expr(f"min({seen})"),
        "last_idx": F.expr(f"max({seen})"),
        "days": F.count("close"),
        **{f"{name}_{field}": F.expr(_at(index, f"`end`.{field}")) for name, index in points.items() for field in ("idx", "close")},
    }
    out = each.groupBy("id", "segment", "at").agg(*[c.alias(n) for n, c in aggs.items()])
    residuals = [F.expr(f"ret_{slug(w)} - beta * bret_{slug(w)}").alias(f"res_{slug(w)}") for w in WINDOWS]
    return out.select("*", *residuals, return_per_vol(F.col("ret_12m"), F.col("vol_1y")).alias("return_per_vol"))


def side_by_side(long: DataFrame, columns: Sequence[str], before: Sequence[str] | None = None) -> DataFrame:
    """One row an id: ``columns`` at the anchor ``now``, and ``before`` (else the same) as prior_* at the earlier one."""
    pick = lambda at, c, name: F.expr(f"max(case when at = '{at}' then {c} end) as {name}")  # noqa: E731 (one row each)
    picks = [pick("now", c, c) for c in columns] + [pick("prior", c, f"prior_{c}") for c in (columns if before is None else before)]
    return long.groupBy("id", "segment").agg(*picks)
