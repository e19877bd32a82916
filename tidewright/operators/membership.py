"""Who is in the universe: segment conflicts, liveness, share classes, price evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import company_key
from tidewright.schema import MAX_STALENESS, MINIMUM_MEMBERS, SEGMENT_RANK


def _segment_rank() -> F.Column:
    c = F.lit(0)
    for segment, rank in SEGMENT_RANK.items():
        c = F.when(F.col("segment") == segment, rank).otherwise(c)
    return c


def segment_conflicts(members: DataFrame) -> DataFrame:
    """``members`` (ticker, segment, seq, ...) with ``keep`` and ``kept_segment``.

    Of rows with one ticker the largest index stays; in one index, the later row.
    """
    w = Window.partitionBy("ticker").orderBy(_segment_rank().desc(), F.col("seq").desc())
    marked = members.withColumn("place", F.row_number().over(w)).withColumn("kept_segment", F.first("segment").over(w))
    return marked.withColumn("keep", F.col("place") == 1).drop("place")


def price_evidence(panel: DataFrame, anchor: int) -> DataFrame:
    """(id, observations, staleness): closes, and days from the last one to the anchor (null if none)."""
    seen = F.when(F.col("close").isNotNull(), F.col("idx"))
    return panel.groupBy("id").agg(F.count("close").alias("observations"), (F.lit(anchor) - F.max(seen)).alias("staleness"))


def liveness(members: DataFrame) -> DataFrame:
    """``members`` (with observations, staleness) and a ``reason`` where a row is not live: no-history, or stale:days."""
    late = F.concat(F.lit("stale:"), F.col("staleness").cast("string"))
    reason = F.when(F.coalesce("observations", F.lit(0)) == 0, F.lit("no-history")).when(F.col("staleness") > MAX_STALENESS, late)
    return members.withColumn("reason", reason)


def share_classes(members: DataFrame) -> DataFrame:
    """``members`` (ticker, name, observations, staleness, market_cap) with ``reason`` where one is left out.

    Of the live rows of one company stays the freshest, then that with most closes, then the most
    valuable, then the first ticker; the others are same-company:ticker. A row without a name, or with words of
    legal forms only, is a company of its own.
    """
    key = company_key(F.col("name"))
    marked = liveness(members).withColumn("company", F.struct(F.when(key != "", key).alias("name"), F.when(F.coalesce(key, F.lit("")) == "", F.col("ticker")).alias("ticker")))
    live = F.col("reason").isNull()
    w = Window.partitionBy("company", live).orderBy(
        "staleness", F.col("observations").desc(), F.coalesce("market_cap", F.lit(0.0)).desc(), "ticker"
    )
    marked = marked.withColumn("place", F.row_number().over(w)).withColumn("winner", F.first("ticker").over(w))
    double = F.concat(F.lit("same-company:"), F.col("winner"))
    return marked.withColumn("reason", F.when(live & (F.col("place") > 1), double).otherwise(F.col("reason"))).drop("company", "place", "winner")


def enrich(holdings: DataFrame, known: DataFrame) -> DataFrame:
    """Fund holdings (ticker, name) with name, sector and industry of an index list, or defaults."""
    k = known.select("ticker", F.col("name").alias("known_name"), "sector", "industry")
    joined = holdings.join(k, "ticker", "left")
    return joined.select(
        "ticker", F.coalesce("known_name", "name", "ticker").alias("name"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.coalesce("industry", F.lit("Unknown")).alias("industry"),
    )


def first_sufficient(routes: list[DataFrame], segment: str) -> DataFrame:
    """The first source with enough members of the segment; an error if none has."""
    need = MINIMUM_MEMBERS[segment]
    for route in routes:
        if route.limit(need).count() >= need:
            return route
    raise ValueError(f"no source has {need} members of segment {segment}")


def require_history(benchmark_panel: DataFrame, minimum: int) -> None:
    """An error if a benchmark has fewer closes than that."""
    short = benchmark_panel.groupBy("id").agg(F.count("close").alias("n")).where(F.col("n") < minimum).limit(5).collect()
    if short:
        raise ValueError(f"too little benchmark history: {', '.join(str(r['id']) for r in short)}")


def market_cap_back_cast(measured: DataFrame) -> DataFrame:
    """``prior_market_cap``: the cap in proportion to the closes at both anchors; null where one is missing.

    measured: (id, market_cap, end_now, end_prior) with the as-of closes.
    """
    return measured.withColumn("prior_market_cap", F.col("market_cap") * F.try_divide(F.col("end_prior"), F.col("end_now")))
