"""The saved settings of a viewer, checked field by field."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.registry import is_metric_id
from tidewright.operators.ranking import Screen
from tidewright.schema import BENCHMARKS

TABS = ("ranked", "watchlist", "portfolio", "settings")
SCHEMES = ("equal", "inverse-vol", "hrp")
SOURCES = ("leaders", "watchlist")
MOST_QUERY, DEFAULT_VALUE, MOST_VALUE = 40, 10_000, 1e9


@dataclass(frozen=True)
class ViewState:
    screen: Screen = Screen()
    tab: str = "ranked"
    watchlist: tuple[str, ...] = ()
    open: str | None = None
    scroll_top: float = 0
    scheme: str = "inverse-vol"
    cap_per_holding: float | None = None
    cap_per_sector: float | None = None
    source: str = "leaders"
    value: int = DEFAULT_VALUE


def _number(v: Any) -> float | None:
    return v if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) else None


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) and v else None


def _cap(v: Any) -> float | None:
    n = _number(v)
    return n if n is not None and 0 < n <= 1 else None


def sanitised(given: Any) -> ViewState:
    """Every field that is not valid falls back to its default."""
    if not isinstance(given, Mapping):
        return ViewState()
    s = given.get("screen") if isinstance(given.get("screen"), Mapping) else {}
    pick = lambda v, options, default: v if isinstance(v, str) and v in options else default
    value = _number(given.get("value"))
    scroll = _number(given.get("scroll_top"))
    listed = given.get("watchlist")
    names = [t for t in listed if _text(t)] if isinstance(listed, list | tuple) else []
    metric_id = s.get("metric_id")
    return ViewState(
        screen=Screen(
            metric_id=metric_id if isinstance(metric_id, str) and is_metric_id(metric_id) else Screen.metric_id,
            segment=pick(s.get("segment"), BENCHMARKS, None),
            sector=_text(s.get("sector")),
            watchlist_only=s.get("watchlist_only") is True,
            invert=s.get("invert") is True,
            query=(_text(s.get("query")) or "")[:MOST_QUERY],
        ),
        tab=pick(given.get("tab"), TABS, "ranked"),
        watchlist=tuple(dict.fromkeys(names)),
        open=_text(given.get("open")),
        scroll_top=max(0, scroll) if scroll is not None else 0,
        scheme=pick(given.get("scheme"), SCHEMES, "inverse-vol"),
        cap_per_holding=_cap(given.get("cap_per_holding")),
        cap_per_sector=_cap(given.get("cap_per_sector")),
        source=pick(given.get("source"), SOURCES, "leaders"),
        value=math.floor(value + 0.5) if value is not None and 1 <= value <= MOST_VALUE else DEFAULT_VALUE,
    )


def save(state: ViewState, path: str) -> None:
    """Errors cost persistence only."""
    try:
        Path(path).write_text(json.dumps(asdict(state)))
    except OSError:
        return


def load(path: str) -> ViewState:
    try:
        return sanitised(json.loads(Path(path).read_text()))
    except (OSError, ValueError):
        return ViewState()


def toggled(state: ViewState, ticker: str) -> ViewState:
    """The ticker at the end of the watchlist, or gone from it."""
    own = state.watchlist
    return replace(state, watchlist=tuple(t for t in own if t != ticker) if ticker in own else (*own, ticker))


def toggled_column(watchlist: Column, ticker: Column) -> Column:
    return F.when(F.array_contains(watchlist, ticker), F.array_remove(watchlist, ticker)).otherwise(F.array_append(watchlist, ticker))
