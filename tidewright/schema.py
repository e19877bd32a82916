"""Fixed values of the data model: windows, lookbacks, thresholds, segments, sectors."""

from __future__ import annotations

#: id -> (formation, skip), in trading days.
WINDOWS = {"1M": (21, 0), "3M": (63, 0), "6M": (126, 0), "12M": (252, 0), "12-1": (252, 21), "6-1": (126, 21)}
RANK_WINDOWS = ("12M", "6M", "12-1", "6-1")
VOLATILITY_WINDOWS = {"3M": 63, "1Y": 252}
BETA_LOOKBACK = 756
DRAWDOWN_LOOKBACK = 252
RANGE_LOOKBACK = 252
RANK_CHANGE_OFFSET = 63
TOLERANCE = 5
ANNUAL_DAYS = 252
COVERAGE = 0.6
MIN_REGRESSION_OBS = 120
MIN_ALLOCATION_DAYS = 120
MAX_STALENESS = 21
EARNINGS_MAX_AGE = 63
EARNINGS_RETENTION_DAYS = 220
EARNINGS_CHUNK_DAYS = 14
FETCH_OVERLAP_DAYS = 7
DATASET_VERSION = 3
SHRINKAGE = 0.2
#: Holdings of one allocation: the driver holds a row of each.
MAX_HOLDINGS = 50_000

#: Segment -> benchmark, largest index first.
BENCHMARKS = {"500": "SPY", "400": "IJH", "600": "IJR"}
BENCHMARK_TICKERS = tuple(BENCHMARKS.values())
#: Days of history that a store keeps, in trading days: the longest lookback, the earlier anchor and some slack.
HISTORY_DAYS = BETA_LOOKBACK + RANK_CHANGE_OFFSET + 30
#: Larger wins a conflict.
SEGMENT_RANK = {"500": 3, "400": 2, "600": 1}
MINIMUM_MEMBERS = {"500": 450, "400": 350, "600": 500}

#: The canonical sectors.
GICS_SECTORS = (
    "Communication Services",
    "Consumer Discretionary",
    "Consumer Staples",
    "Energy",
    "Financials",
    "Health Care",
    "Industrials",
    "Information Technology",
    "Materials",
    "Real Estate",
    "Utilities",
)
#: Other labels of providers, lower-cased; each canonical name also stands for itself.
SECTOR_ALIASES = {
    "basic materials": "Materials",
    "consumer cyclical": "Consumer Discretionary",
    "consumer defensive": "Consumer Staples",
    "financial": "Financials",
    "financial services": "Financials",
    "healthcare": "Health Care",
    "technology": "Information Technology",
    "telecommunication services": "Communication Services",
}


def benchmark_for(segment: str) -> str:
    """The benchmark of a segment; an unknown one is an error, never another segment's benchmark."""
    if segment not in BENCHMARKS:
        raise ValueError(f"no such segment: {segment}")
    return BENCHMARKS[segment]


def is_segment(value: str) -> bool:
    return value in BENCHMARKS


def slug(window: str) -> str:
    """A window id as part of a column name."""
    return window.lower().replace("-", "_")
