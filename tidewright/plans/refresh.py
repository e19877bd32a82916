"""The batch refresh: provider answers in, stores brought up to date, a validated version published.

Whatever a provider fails to give costs freshness only: an id whose request failed keeps its cached
closes and counts as stale, and the announcements stay as they were. A benchmark with too little
history, or an error among the issues, stops the run before anything is published.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import membership, merge, ranking, regime, series, universe, validation
from tidewright.schema import BENCHMARKS, BETA_LOOKBACK, DATASET_VERSION, HISTORY_DAYS, RANK_CHANGE_OFFSET, WINDOWS
from tidewright.scratch import kept, local_table
from tidewright.sources import readers, sinks, stores

#: Calendar days that hold the trading days of the history, with some slack.
HISTORY_CALENDAR_DAYS = HISTORY_DAYS * 365 // 252 + 30


@dataclass
class Answers:
    """What the providers gave, as tables.

    constituents: segment, symbol, name, sector, subSector, seq. quotes: symbol, name, exchange, price,
    marketCap, yearLow, yearHigh, seq. closes: id, date, close, seq, of securities and benchmarks.
    failed: id, error of requests for closes. announcements(start, end): symbol, date, epsActual,
    epsEstimated, revenueActual, revenueEstimated, seq of all symbols; it may raise.
    """

    constituents: DataFrame
    quotes: DataFrame
    closes: DataFrame
    failed: DataFrame
    announcements: Callable[[dt.date, dt.date], DataFrame]


@dataclass
class Refreshed:
    version: str
    outcomes: DataFrame
    excluded: DataFrame
    issues: DataFrame
    orphans: int


def wanted(spark: SparkSession, ids: DataFrame, root: str, today: dt.date) -> DataFrame:
    """(id, fetch_from): from which day on to ask for the closes of each id (and benchmark)."""
    cold = today - dt.timedelta(days=1 + HISTORY_CALENDAR_DAYS)
    known = merge.fetch_from(stores.PriceStore(spark, f"{root}/closes").points(), cold)
    every = ids.select("id").unionByName(local_table(spark, {"id": pa.array(list(BENCHMARKS.values()))})).distinct()
    return every.join(known, "id", "left").select("id", F.coalesce("fetch_from", F.lit(cold)).alias("fetch_from"))


def refresh(spark: SparkSession, answers: Answers, root: str, today: dt.date, minimum: int = validation.MINIMUM, per_segment: int | None = None) -> Refreshed:
    """One run; ``root`` holds the stores ``closes`` and ``announcements`` and the published ``site``."""
    to = today - dt.timedelta(days=1)  # only settled closes
    retain = to - dt.timedelta(days=HISTORY_CALENDAR_DAYS + 30)

    # Who could be in.
    listed = readers.constituents(answers.constituents, ["segment", "seq"])
    placed = kept(membership.segment_conflicts(listed), "listed")
    candidates = placed.where("keep").select(F.col("ticker").alias("id"), "name", "segment", "sector", "industry")
    if per_segment:
        candidates = ranking.capped_per_segment(candidates, per_segment)
    caps = readers.quotes(answers.quotes).select(text.ticker(F.col("symbol")).alias("id"), "market_cap")
    members = kept(candidates.join(caps, "id", "left"), "candidates")

    # Closes: merged over what is cached; a failed id keeps its history.
    store = stores.PriceStore(spark, f"{root}/closes")
    cached = kept(store.points(), "cached")
    closes = readers.adjusted_closes(answers.closes.where(F.col("date") <= F.lit(to.isoformat())))
    fetched = kept(closes.join(answers.failed.select("id").distinct(), "id", "left_anti"), "fetched")
    store.merge(fetched, retain)
    merged = kept(store.points().where(F.col("date") >= F.lit(retain)), "merged")
    outcomes = kept(merge.outcomes(cached, fetched, merged, answers.failed), "outcomes")

    # Announcements, fetched for the missing days.
    _, events = stores.EarningsStore(spark, f"{root}/announcements").refresh(to, lambda a, b: readers.earnings_between(answers.announcements(a, b), a, b).withColumn("seq", F.lit(0)))

    # Securities and benchmarks on the benchmarks' days.
    segments = local_table(spark, {"segment": pa.array(list(BENCHMARKS)), "benchmark": pa.array(list(BENCHMARKS.values()))})
    bench = kept(merged.join(segments.withColumnRenamed("benchmark", "id"), "id").select(F.col("segment").alias("id"), "date", "close"), "benchmarks")
    found = bench.select("id").distinct().count()
    if found < len(BENCHMARKS):
        raise ValueError(f"closes of {found} benchmarks, not {len(BENCHMARKS)}")
    membership.require_history(bench, BETA_LOOKBACK // 2)
    obs = merged.join(members.select("id"), "id", "left_semi")
    aligned = universe.align(obs, bench, members)
    orphans = series.orphans(obs, aligned.cal).count()

    # Of the live members one share class a company stays.
    evidence = membership.price_evidence(aligned.panel, aligned.anchor)
    judged = kept(membership.share_classes(members.withColumnRenamed("id", "ticker").join(evidence.withColumnRenamed("id", "ticker"), "ticker", "left")), "judged")
    eligible = judged.where("reason is null").select(F.col("ticker").alias("id"))
    lost = judged.where("reason is not null").select(F.col("ticker").alias("id"), "reason")
    conflicts = placed.where("not keep").select(F.col("ticker").alias("id"), F.concat(F.lit("listed-in:"), "kept_segment").alias("reason"))
    excluded = kept(conflicts.unionByName(lost), "excluded")

    flat = universe.dated(universe.records(aligned, events), aligned).join(eligible, "id", "left_semi")
    flat = flat.join(members.select("id", "industry"), "id").join(segments, "segment").join(outcomes.select("id", "stale"), "id", "left")
    flat = kept(flat, "records")
    manifest = _manifest(spark, aligned, flat, excluded, today)
    issues = kept(validation.validate(flat, manifest, minimum=minimum), "issues")
    table = local_table(spark, {"manifest": pa.array([json.dumps(manifest, sort_keys=True)])}).select(
        "manifest", F.lit(manifest["as_of"]).alias("as_of"), F.lit(DATASET_VERSION).alias("format")
    )
    version = sinks.publish(universe.nested(sinks.rounded_frame(flat)), aligned.panel.join(eligible, "id", "left_semi"), table, f"{root}/site", issues)
    return Refreshed(version, outcomes, excluded, issues, orphans)


def _manifest(spark: SparkSession, aligned: universe.Aligned, flat: DataFrame, excluded: DataFrame, today: dt.date) -> dict:
    """What the version holds, as plain values: counts, settings, market state of the largest index."""
    counts = {r["segment"]: r["n"] for r in flat.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    reasons = {r["kind"]: r["n"] for r in excluded.groupBy(F.element_at(F.split("reason", ":"), 1).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    panel = series.densify(aligned.bench.where(F.col("id") == next(iter(BENCHMARKS))), aligned.cal, len(aligned.dates))
    state = regime.of_panel(panel, aligned.anchor).first()
    return {
        "format": DATASET_VERSION, "made": today.isoformat(), "as_of": aligned.dates[-1].isoformat() if aligned.dates else "", "calendar_days": len(aligned.dates),
        "benchmarks": dict(BENCHMARKS), "membership": sorted(counts), "counts": counts, "excluded": reasons, "windows": {k: list(v) for k, v in WINDOWS.items()},
        "beta_lookback": BETA_LOOKBACK, "rank_change_offset": RANK_CHANGE_OFFSET, "market": state.asDict() if state else None,
    }
