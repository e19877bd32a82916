"""The metrics that can be ranked: sixteen generated ones and seven alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import formats
from tidewright.schema import RANK_CHANGE_OFFSET, slug


@dataclass(frozen=True)
class RankSpec:
    window: str = "12M"
    skip: bool = True
    residual: bool = False
    per_vol: bool = False

    @property
    def window_id(self) -> str:
        return f"{self.window[:-1]}-1" if self.skip else self.window

    @property
    def id(self) -> str:
        return f"{'res-' * self.residual}{self.window_id}{'-v' * self.per_vol}"

    @property
    def _core(self) -> str:
        return self.window_id.replace("-", "−")

    @property
    def label(self) -> str:
        name = f"Residual {self._core}" if self.residual else f"{self._core} Return"
        return f"{name} / Vol" if self.per_vol else name

    @property
    def short(self) -> str:
        return f"{'R' * self.residual}{self._core}{'/V' * self.per_vol}"

    @property
    def definition(self) -> str:
        days = 252 if self.window == "12M" else 126
        parts = [f"Return over {days} trading days" + (", ending 21 trading days back." if self.skip else ".")]
        if self.residual:
            parts.append("Less beta times the segment benchmark's return; the intercept stays in.")
        if self.per_vol:
            parts.append(f"Per annualised volatility of the window's daily {'residuals' if self.residual else 'returns'}.")
        return " ".join(parts)

    @property
    def value(self) -> Column:
        s = slug(self.window_id)
        top = F.col(f"{'res' if self.residual else 'ret'}_{s}")
        if not self.per_vol:
            return top
        vol = F.col(f"{'res_vol' if self.residual else 'rank_vol'}_{s}")
        return F.when(vol > 0, F.try_divide(top, vol))

    @property
    def prior(self) -> Column:
        if self.per_vol:
            return F.lit(None).cast("double")
        return F.col(f"prior_{'res' if self.residual else 'ret'}_{slug(self.window_id)}")


def rank_specs() -> list[RankSpec]:
    """All sixteen, the default first."""
    return [RankSpec(w, skip, res, vol) for w, skip, res, vol in product(("12M", "6M"), (True, False), (False, True), (False, True))]


def parse_rank_id(metric_id: str) -> RankSpec | None:
    return {s.id: s for s in rank_specs()}.get(metric_id)


@dataclass(frozen=True)
class Metric:
    id: str
    family: str
    label: str
    short: str
    definition: str
    value_of: Callable[[], Column]
    prior_of: Callable[[], Column]
    format: Callable[[float | None], str]
    descending: bool = True
    kind: str = "value"
    based_on: str | None = None

    @property
    def value(self) -> Column:
        return self.value_of()

    @property
    def prior(self) -> Column:
        return self.prior_of()


def _column(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _none() -> Column:
    return F.lit(None).cast("double")


def _ranked(s: RankSpec) -> Metric:
    return Metric(s.id, "rank", s.label, s.short, s.definition, lambda: s.value, lambda: s.prior, formats.signed_ratio if s.per_vol else formats.percent)


ALL = [
    *map(_ranked, rank_specs()),
    Metric("3M", "momentum", "Return 3M", "3M", "Return over 63 trading days.", _column("ret_3m"), _column("prior_ret_3m"), formats.percent),
    Metric("return-vol", "risk", "Return / vol", "R/V", "12-month return per 1-year volatility, without a risk-free rate.", _column("return_per_vol"), _column("prior_return_per_vol"), formats.signed_ratio),
    Metric("volatility", "risk", "Volatility 1Y", "VOL", "Annualised deviation of daily returns over 252 days, low first.", _column("vol_1y"), _column("prior_vol_1y"), formats.percent_plain, descending=False),
    Metric("beta", "risk", "Beta", "β", "Slope of daily returns on the segment benchmark over three years, low first.", _column("beta"), _none, formats.ratio, descending=False),
    Metric("surprise", "fundamental", "EPS surprise", "SUE", "Latest actual less estimated earnings per share, by the price of that day.", _column("surprise"), _none, lambda v: formats.percent(v, 2)),
    Metric("rank-change", "context", f"{RANK_CHANGE_OFFSET}d rank change", "Δ RANK", "Places climbed in this list's 12−1 ranking.", _column("ret_12_1"), _column("prior_ret_12_1"), formats.signed_integer, kind="rank-change", based_on="12-1"),
    Metric("market-cap", "context", "Market cap", "CAP", "Market value.", _column("market_cap"), _column("prior_market_cap"), formats.market_cap),
]
BY_ID = {m.id: m for m in ALL}
DEFAULT_METRIC = "12-1"


def metric(metric_id: str) -> Metric:
    """The metric, or the default one for an unknown id."""
    return BY_ID.get(metric_id, BY_ID[DEFAULT_METRIC])


def is_metric_id(metric_id: str) -> bool:
    return metric_id in BY_ID
