"""Every query of the engine over the star schema, each with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import formats, registry, text
from tidewright.operators import earnings, groups, measures, membership, merge, portfolio, ranking, regime, series, validation
from tidewright.operators.asof import BACKWARD, FORWARD, asof
from tidewright.operators.universe import Aligned, align, dated, excluded, records
from tidewright.plans import allocation_sql, provider_queries
from tidewright.plans import oracle as sql
from tidewright.plans.oracle import r6
from tidewright.schema import MAX_HOLDINGS, RANK_WINDOWS, WINDOWS, slug
from tidewright.scratch import kept, local_table, new_path
from tidewright.sources import adapters, catalog, readers, sinks
from tidewright.sources.sinks import rounded, rounded_frame
from tidewright.sources.stores import PriceStore
from tidewright.streaming import rolling

Query = Callable[[SparkSession, str], DataFrame]


def model(spark: SparkSession, sf_dir: str, thin: bool = False) -> Aligned:
    """The panel over one written weekly table: lineitem is aggregated once. thin: with gaps, late starts and early ends."""
    weeks, members = kept(adapters.weekly(spark, sf_dir), "weekly"), adapters.members(spark, sf_dir)
    bench = series.clean(adapters.benchmark_observations(weeks, members), unique=True)
    obs = series.clean(adapters.observations(weeks.where(THINNED) if thin else weeks), unique=True)
    return align(obs, bench, members)


def universe(spark: SparkSession, sf_dir: str, events: bool = False) -> DataFrame:
    """The published record of every security, rounded as published; rankings are over these values. events: with announcements."""
    return rounded_frame(records(model(spark, sf_dir), adapters.announcements(spark, sf_dir) if events else None))


#: What stays of the weeks of a supplier in the thinned panel: seven of nine weeks, from or up to some week for two groups, none for a third.
THINNED = """(id + datediff(date, date'1992-01-06') div 7) % 9 not in (4, 5)
  and not (id % 7 = 3 and date < date'1995-07-01') and not (id % 7 = 5 and date > date'1998-03-01') and id % 17 <> 11"""
THINNED_SQL = THINNED.replace("datediff(date, date'1992-01-06') div 7", "(date - date '1992-01-06') // 7")


def _measures(columns: list[str], at: str = "now", thin: bool = False) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = model(spark, sf_dir, thin)
        wanted = [a for a in m.anchors if a[0] == at]
        return rounded_frame(measures.measured(m.days, wanted).select("id", *columns))

    return run, sql.thinned(sql.measures(columns, at), THINNED_SQL) if thin else sql.measures(columns, at)


def _screen(view: ranking.Screen, pool: str = "true") -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ranking.screen(universe(spark, sf_dir, view.metric_id == "surprise"), view, WATCHLIST)
        return found.select("id", "rank", rounded(F.col("value")).alias("value"), "change")

    m = registry.metric(view.metric_id)
    value, prior = _SQL_METRIC.get(m.id, (None, None))
    if value is None:
        spec = registry.parse_rank_id(m.id)
        s = slug(spec.window_id)
        value, prior = f"{'res' if spec.residual else 'ret'}_{s}", f"prior_{'res' if spec.residual else 'ret'}_{s}"
        if spec.per_vol:
            vol = f"{'res_vol' if spec.residual else 'rank_vol'}_{s}"
            value, prior = f"case when {vol} > 0 then {value} / {vol} end", "null::double"
    return run, sql.screen(value, prior, m.descending, pool, view.invert, m.kind == "rank-change")


_SQL_METRIC = {
    "3M": ("ret_3m", "prior_ret_3m"),
    "return-vol": ("return_per_vol", "prior_return_per_vol"),
    "volatility": ("vol_1y", "prior_vol_1y"),
    "beta": ("beta", "null::double"),
    "surprise": ("surprise", "null::double"),
    "rank-change": ("ret_12_1", "prior_ret_12_1"),
    "market-cap": ("market_cap", "prior_market_cap"),
}
WATCHLIST = list(range(1, 41))


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return m.days.where("ret is not null").select("id", "idx", rounded(F.col("ret")).alias("ret"))


def endpoints_every_day(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    """The as-of endpoint of each day."""
    m = model(spark, sf_dir, thin)
    return m.days.select("id", "idx", F.col("end.idx").alias("end_idx"), rounded(F.col("end.close")).alias("end_close"))


def calendar_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipments on days outside a calendar of even-numbered weeks."""
    m = model(spark, sf_dir)
    some = m.cal.where("idx % 2 = 0")
    return series.orphans(m.obs, some).groupBy("id").agg(F.count(F.lit(1)).alias("orphans"))


def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    dates = adapters.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return series.index_at_or_after(dates, m.cal)


def _events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds)).select("user_id", "ts", "event_id", "value")


def events_view_before_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the last view of its user at or before it."""
    found = asof(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "view"), "ts", ["user_id"], BACKWARD, ["event_id"])
    return found.select("event_id", F.col("match.event_id").alias("view_id"), F.col("match.value").alias("view_value"))


def events_error_after_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the first error of any user in the six hours from it on."""
    found = asof(_events(spark, sf_dir, "view"), _events(spark, sf_dir, "error"), "ts", (), FORWARD, ["event_id"], 6 * 3600 * 1_000_000)
    return found.select("event_id", F.col("match.event_id").alias("error_id"))


def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of closes of their users, some files a micro-batch: the view of every user after the last one."""
    events = adapters.read(spark, sf_dir, "events")
    points = events.select(F.col("user_id").alias("id"), F.to_date("ts").alias("date"), F.col("value").alias("close"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    source = new_path(spark, "points")
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points.repartition(files).write.parquet(source)
    arriving = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(source)
    out = new_path(spark, "rolling")
    rolling.run_to_end(spark, rolling.rolling_stream(arriving, 90, "60 days"), out, new_path(spark, "rolling-checkpoint"))
    return rounded_frame(rolling.latest(spark.read.parquet(out).drop("run")))


def gap_islands(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    found = series.gap_segments(model(spark, sf_dir, thin).panel)
    return found.groupBy("id", "segment_no").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("points")).where("points >= 2")


def horizon_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.tail(model(spark, sf_dir).panel, 63).where("close is not null").select("id", "idx", rounded(F.col("close"), 4).alias("close"))


def sector_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leaders(universe(spark, sf_dir)).select("segment", "sector", "id", "average_rank", "of")


def empty_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    nations = [r[0] for r in adapters.read(spark, sf_dir, "nation").select("n_name").distinct().collect()]
    regions = [r[0] for r in adapters.read(spark, sf_dir, "region").select("r_name").distinct().collect()]
    return ranking.empty_slots(u, regions, nations)


def distinct_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.members(spark, sf_dir).select("sector").where("sector <> ''").distinct().orderBy("sector")


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_frame(groups.summary(universe(spark, sf_dir), "ret_12_1", ["segment"]))


def sector_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_frame(groups.concentration(adapters.members(spark, sf_dir), "sector"))


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.members(spark, sf_dir).rollup("segment").agg(F.count(F.lit(1)).alias("n"))


def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_frame(groups.coverage(universe(spark, sf_dir), F.col("vol_1y").isNotNull()))


def segment_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapters.members(spark, sf_dir).withColumn("market_cap", F.greatest(F.lit(0.0), "market_cap").cast("decimal(18,2)"))
    out = groups.subtotals(held, "segment", "market_cap")
    return out.select("segment", F.col("amount").cast("double").alias("amount"), F.col("largest").cast("double").alias("largest"), rounded(F.col("share").cast("double")).alias("share"))


def range_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    u = measures.measured(m.days, m.anchors[:1])
    return u.select("id", rounded(groups.range_position(F.col("last"), F.col("low52"), F.col("high52")), 4).alias("position"))


def _held_returns(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    """Returns of the brands' prices on the common calendar, written once; None: of all brands."""
    dates = series.trading_days(series.clean(adapters.benchmark_observations(adapters.weekly(spark, sf_dir), adapters.members(spark, sf_dir)), unique=True))
    held = kept(series.clean(adapters.brand_observations(spark, sf_dir, brands), unique=True), "held")
    panel = series.densify(held, series.calendar_table(spark, dates), len(dates))
    return kept(series.with_returns(panel).select("id", "idx", "ret"), "held-returns")


def _synchronised(spark: SparkSession, sf_dir: str, brands: list[str] | None) -> DataFrame:
    return groups.synchronised(_held_returns(spark, sf_dir, brands))


def sync_days(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return _synchronised(spark, sf_dir, brands).select("idx").distinct()


def correlation_pairs(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return rounded_frame(groups.correlations(_synchronised(spark, sf_dir, brands)))


def correlation_matrix(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return rounded_frame(groups.correlation_matrix(_synchronised(spark, sf_dir, brands)))


def average_correlation(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return rounded_frame(groups.average_correlation(_synchronised(spark, sf_dir, brands)))


def covariance_pairs(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return rounded_frame(groups.covariances(_synchronised(spark, sf_dir, brands)))


def _shrunk(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    """Shrunk covariances: as wide as the holdings at most, written, as several steps read them."""
    return kept(groups.shrunk(kept(groups.covariances(_synchronised(spark, sf_dir, brands)), "covariances")), "shrunk")


def shrunk_covariance(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return rounded_frame(_shrunk(spark, sf_dir, brands))


def correlation_distance(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    return rounded_frame(groups.correlation_distance(groups.to_correlation(_shrunk(spark, sf_dir, brands))))


def allocation_equal(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    cov = _shrunk(spark, sf_dir, brands)
    return rounded_frame(groups.risk(groups.equal_weights(cov), cov))


def allocation_inverse_vol(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    cov = _shrunk(spark, sf_dir, brands)
    return rounded_frame(groups.risk(groups.inverse_volatility_weights(cov), cov))


def all_brands(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every brand of part, in order; more than the allocation takes is an error."""
    rows = adapters.read(spark, sf_dir, "part").select("p_brand").where("p_brand is not null").distinct().limit(MAX_HOLDINGS + 1).collect()
    if len(rows) > MAX_HOLDINGS:
        raise ValueError(f"more than {MAX_HOLDINGS} brands")
    return sorted(r[0] for r in rows)


def _allocated(scheme: str, per_holding: float | None = None, per_group: float | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
        names = all_brands(spark, sf_dir) if brands is None else brands
        held = local_table(spark, {"id": pa.array(names), "group": pa.array([f"group {i % 3}" for i in range(len(names))])})
        return rounded_frame(portfolio.allocate(_held_returns(spark, sf_dir, brands), held, scheme, per_holding, per_group))

    return run


def cash_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapters.members(spark, sf_dir).select("id", "segment", F.greatest(F.lit(0.0), "market_cap").alias("weight"))
    return ranking.cash_amounts(held, 100_000, "id", ["segment"]).select("id", "segment", "amount")


def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each region's own index."""
    bench = series.clean(adapters.benchmark_observations(adapters.weekly(spark, sf_dir), adapters.members(spark, sf_dir)), unique=True)
    bench = kept(bench, "benchmarks")
    dates = series.trading_days(bench)
    at = regime.of_panel(series.densify(bench, series.calendar_table(spark, dates), len(dates)), len(dates) - 1)
    columns = [rounded(F.col(c)).alias(c) for c in ("from_high", "ret_6m", "ret_1m")]
    shown = at.select(F.col("id").alias("segment"), *columns)
    return shown.withColumn("state", regime.classify(F.col("from_high"), F.col("ret_6m"), F.col("ret_1m")))


def regime_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = market_regime(spark, sf_dir)
    return s.select("segment", regime.describe(F.col("state"), F.col("from_high")).alias("banner"))


def earnings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return rounded_frame(earnings.latest(adapters.announcements(spark, sf_dir), m.days, m.dates))


SPLIT = dt.date(1999, 1, 1)
RETAIN = dt.date(1996, 1, 1)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.read(spark, sf_dir, "lineitem")
    price = F.max(F.col("l_extendedprice") / F.col("l_quantity"))
    return lines.groupBy(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date")).agg(price.alias("close"))


def _cached_and_fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """History up to a day, and a refetch that overlaps it with other values."""
    daily = _daily(spark, sf_dir)
    return daily.where(F.col("date") < F.lit(SPLIT)), daily.where(F.col("date") >= F.date_sub(F.lit(SPLIT), 30)).withColumn("close", F.col("close") * 2)


def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.last_wins(*_cached_and_fetched(spark, sf_dir), RETAIN)
    return merged.select("id", "date", rounded(F.col("close")).alias("close"))


def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.first_wins(*_cached_and_fetched(spark, sf_dir), RETAIN, seq="close")
    return merged.select("id", "date", rounded(F.col("close")).alias("close"))


def fetch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fetch_from(_cached_and_fetched(spark, sf_dir)[0], dt.date(1998, 12, 28))


def refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached, fetched = _cached_and_fetched(spark, sf_dir)
    fetched = fetched.where("id % 5 <> 0")
    return merge.outcomes(cached, fetched, merge.last_wins(cached, fetched, dt.date(1990, 1, 1)))


def fetch_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days from the first order to the last, in pieces of a fetch."""
    days = adapters.read(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    return merge.tiles(spark, days[0], days[1])


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed names: a ticker of brand and size, in the index that its key falls in."""
    p = adapters.read(spark, sf_dir, "part")
    segment = F.element_at(F.array(F.lit("500"), F.lit("400"), F.lit("600")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("ticker"), F.col("p_type").alias("name"), segment.alias("segment"), F.col("p_partkey").alias("seq"))


def segment_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.segment_conflicts(_listed(spark, sf_dir)).select("ticker", "segment", "seq", "keep", "kept_segment")


def price_evidence(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    m = model(spark, sf_dir, thin)
    return membership.price_evidence(m.panel, m.anchor)


def share_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose company is their nation: one stays for each."""
    m = model(spark, sf_dir)
    rows = m.members.join(membership.price_evidence(m.panel, m.anchor), "id", "left")
    rows = rows.select(F.col("name").alias("ticker"), F.concat(F.col("sector"), F.lit(" Holdings, Inc. (Class A)")).alias("name"), "observations", "staleness", "market_cap")
    return membership.share_classes(rows).select("ticker", "reason")


def capped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped_per_segment(adapters.members(spark, sf_dir), 3).select("segment", "id")


def holdings_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.read(spark, sf_dir, "supplier")
    fund = c.select(F.col("s_name").alias("ticker"), F.lit(None).cast("string").alias("name"))
    known = adapters.members(spark, sf_dir).where("id % 2 = 0").select(F.col("name").alias("ticker"), F.concat(F.lit("Name of "), "name").alias("name"), "sector", F.col("segment").alias("industry"))
    return membership.enrich(fund, known)


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir).withColumn("benchmark", F.when(F.col("id") % 9 == 0, "OTHER").otherwise(F.col("segment")))
    u = u.withColumn("last", F.when(F.col("id") % 13 == 0, 0.0).otherwise(F.col("last"))).withColumn("stale", F.col("id") % 4 == 0)
    regions = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NOWHERE")
    rows = validation.row_issues(u, {r: r for r in regions})
    return rows.unionByName(validation.set_issues(u, regions))


def watchlist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [7, 3, 9, 10_000_000, 1]
    return ranking.in_list_order(adapters.members(spark, sf_dir).select("id", "name"), ids)


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.read(spark, sf_dir, "customer")
    return n.select("c_custkey", text.ticker(F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit(" "))).alias("ticker"))


def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.read(spark, sf_dir, "customer")
    return c.select("c_custkey", text.company_key(F.concat(F.lit("The "), F.col("c_mktsegment"), F.lit(" Co., Ltd. (Class B)"))).alias("company"))


def canonical_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of parts whose labels are written as providers do; every sixth has none."""
    return adapters.read(spark, sf_dir, "part").select("p_partkey", text.sector(provider_queries.label("p_partkey")).alias("sector"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.read(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(readers.plain_text(F.col("html"))).alias("text_md5"))


def last_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer as its quote."""
    o = adapters.read(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("exchange"),
        F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("marketCap"), F.lit(None).cast("double").alias("yearLow"),
        F.lit(None).cast("double").alias("yearHigh"), F.col("o_orderkey").alias("seq"),
    )
    return readers.quotes(raw).select("symbol", "name", "price")


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    return u.select("id", formats.percent_column(F.col("ret_12_1")).alias("ret"), formats.ratio_column(F.col("beta")).alias("beta"), formats.market_cap_column(F.col("market_cap")).alias("cap"), formats.market_cap_column(F.col("market_cap") * 1e8).alias("cap_of_bonds"))


def series_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir, thin=True)
    return dated(measures.measured(m.days, m.anchors[:1]), m).select("id", "first_date", "last_date", "days")


def returns_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a week that depends on the id to the 300th; none where the first comes later."""
    days = model(spark, sf_dir, thin=True).days.withColumn("start", (F.col("id") * 7 % 330).cast("int"))
    return days.groupBy("id").agg(rounded(measures.return_between("start", "300")).alias("ret"))


def no_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded(model(spark, sf_dir, thin=True))


def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the flagship ranking that a list of twelve shows from the 21st place on."""
    return ranking.viewport(rank_12_1(spark, sf_dir), 20, 12).select("id", "rank", "value")


def _repeated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """History up to a day, and each line of a shipment since a month before it as its own fetched close, in the order of its keys."""
    lines = adapters.read(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity") * 2).alias("close"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")
    )
    return _cached_and_fetched(spark, sf_dir)[0], rows.where(F.col("date") >= F.date_sub(F.lit(SPLIT), 30))


def merge_last_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.last_wins(*_repeated(spark, sf_dir), RETAIN, seq="seq")
    return merged.select("id", "date", rounded(F.col("close")).alias("close"))


def merge_first_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.first_wins(*_repeated(spark, sf_dir), RETAIN, seq="seq")
    return merged.select("id", "date", rounded(F.col("close")).alias("close"))


def refresh_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes where the requests of every tenth supplier failed: these keep their history."""
    cached, fetched = _cached_and_fetched(spark, sf_dir)
    fetched = fetched.where("id % 5 <> 0")
    failed = adapters.members(spark, sf_dir).where("id % 10 = 0").select("id", F.lit("status 500").alias("error"))
    return merge.outcomes(cached, fetched, merge.last_wins(cached, fetched, dt.date(1990, 1, 1)), failed)


def _cache(spark: SparkSession, sf_dir: str) -> PriceStore:
    """The history in a cache: then a refetch of every fifth supplier is merged, and every eleventh supplier forgotten."""
    cached, fetched = _cached_and_fetched(spark, sf_dir)
    store = PriceStore(spark, new_path(spark, "closes"), "id long, date date, close double")
    store.write(cached)
    store.merge(fetched.where("id % 5 = 0"), RETAIN)
    store.forget(adapters.members(spark, sf_dir).where("id % 11 = 0"))
    return store


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the cache holds after both changes, from the day on that is kept."""
    return _cache(spark, sf_dir).read(since=RETAIN).select("id", "date", rounded(F.col("close")).alias("close"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some ids of it; unknown and forgotten ones have no rows."""
    return _cache(spark, sf_dir).read([5, 11, 12, 10_000_000]).where(F.col("date") >= F.lit(RETAIN)).select("id", "date", rounded(F.col("close")).alias("close"))


def sql_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked in SQL over the cache: where each id's last close lies in its range of two years."""
    catalog.register(spark, _cache(spark, sf_dir), prefix="cached_")
    found = spark.sql("""select id, count(*) as days, range_position(max_by(close, date), min(close), max(close)) as position
        from cached_closes where date >= date'1997-01-01' group by id""")
    return rounded_frame(found)


def sql_one_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked in SQL for one series of the published panel: one partition is opened."""
    _site(spark, sf_dir, "one_")
    return spark.sql("select id, idx, close from one_series_of(7L)")


def _site(spark: SparkSession, sf_dir: str, prefix: str) -> None:
    """The panel, published and registered."""
    m = model(spark, sf_dir, thin=True)
    site = new_path(spark, "site")
    columns = {"calendar_days": pa.array([len(m.dates)])}
    sinks.publish(m.members.select("id", "segment"), m.panel, local_table(spark, columns), site)
    catalog.register(spark, site=site, prefix=prefix)


def published_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked in SQL over the published panel: from each id's first close on, at four digits."""
    _site(spark, sf_dir, "site_")
    return spark.sql("select s.id, u.segment, s.idx, s.close from site_series s join site_universe u on u.id = s.id")


def rank_12_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the 12-1 ranking of all securities, with moves against a quarter before."""
    found = ranking.screen(universe(spark, sf_dir), ranking.Screen())
    return found.where("rank > 0").select("id", "segment", "sector", "rank", "value", "change")


def _allocated_flat(*caps: str | float | None) -> Query:
    """An allocation with its warnings as one text."""
    return lambda spark, sf_dir: _allocated(*caps)(spark, sf_dir).withColumn("warnings", F.concat_ws("; ", "warnings"))


#: Caps that bind over 25 brands in three groups.
TIGHT = 0.045, 0.335
_P, _U = sql.PANEL, sql.UNIVERSE
_SYNC = f"""{_P},
sobs as (select p_brand as id, date_trunc('week', l_shipdate)::date as date, sum(l_extendedprice::decimal(18,2))::double / sum(l_quantity::decimal(18,2))::double as close
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
spanel as (select s.id, c.idx, o.close from (select distinct id from sobs) s cross join cal c left join sobs o on o.id = s.id and o.date = c.date),
held as (select id, idx, close / lag(close) over (partition by id order by idx) - 1 as ret from spanel),
full_days as (select idx from held where ret is not null group by idx having count(*) = (select count(distinct id) from held)),
syn as (select id, idx, ret from held join full_days using (idx) where ret is not null)"""
_COV = f"""{_SYNC},
cov as (select a.id as i, b.id as j, case when count(*) >= 2 then covar_samp(a.ret, b.ret) * 252 else 0.0 end as cov
  from syn a join syn b on a.idx = b.idx and a.id <= b.id group by 1, 2),
sd as (select i as id, sqrt(greatest(0.0, cov)) as s from cov where i = j),
mean as (select coalesce(avg(cov / (a.s * b.s)), 0.0) as r from cov join sd a on a.id = i join sd b on b.id = j where i <> j and a.s * b.s > 1e-18),
shr as (select i, j, case when i = j then cov else 0.8 * cov + 0.2 * r * a.s * b.s end as cov from cov join sd a on a.id = i join sd b on b.id = j cross join mean)"""
_RISK = """,
fullm as (select i, j, cov from shr union all select j, i, cov from shr where i <> j),
marg as (select i as id, sum(cov * weight) as marginal from fullm join w on w.id = j group by 1),
tot as (select sqrt(greatest(0.0, sum(weight * marginal))) as p from w join marg using (id))
select w.id, {w} as weight, {v} as volatility, {c} as contribution, {p} as portfolio_volatility
from w join marg using (id) join shr on shr.i = w.id and shr.j = w.id cross join tot""".format(
    w=r6("weight"), v=r6("sqrt(greatest(0.0, cov))"), c=r6("case when p > 1e-12 then weight * marginal / (p * p) else 0.0 end"), p=r6("p")
)
_MERGE = """
with daily as (select l_suppkey as id, l_shipdate::date as date, max(l_extendedprice / l_quantity) as close from lineitem group by 1, 2),
cached as (select * from daily where date < date '1999-01-01'),
fetched as (select id, date, close * 2 as close from daily where date >= date '1999-01-01' - 30)"""
_PUBLISHED = sql.thinned(f"""{_P}, f as (select id, min(idx) as first from panel where close is not null group by id)
  select p.id, segment, p.idx, floor(close * 1e4 + 0.5) / 1e4 as close from panel p join f using (id) join members m on m.id = p.id where p.idx >= first""", THINNED_SQL)
_RAW_CACHE = f"""{_MERGE} select id, date, coalesce(f.close, c.close) as close
  from cached c full join (select * from fetched where id % 5 = 0) f using (id, date) where id % 11 <> 0"""
_CACHE = f"""{_MERGE} select id, date, {r6('coalesce(f.close, c.close)')} as close
  from cached c full join (select * from fetched where id % 5 = 0) f using (id, date) where date >= date '1996-01-01' and id % 11 <> 0"""
_CONFLICTS = """
with listed as (
  select p_brand || '-' || p_size as ticker, (['500', '400', '600'])[p_partkey % 3 + 1] as segment, p_partkey as seq from part),
placed as (
  select *, row_number() over w as place, first_value(segment) over w as kept_segment from listed
  window w as (partition by ticker order by case segment when '500' then 3 when '400' then 2 else 1 end desc, seq desc))
select ticker, segment, seq, place = 1 as keep, kept_segment from placed"""
_EVIDENCE = f"{_P}, ev as (select id, count(close) as observations, any_value(anchor) - max(case when close is not null then idx end) as staleness from panel cross join size group by id)"
_STATES = ", ".join(f"{r6(x)} as {c}" for c, x in (("from_high", "max(case when idx = anchor then close end) / max(case when idx between anchor - 251 and anchor then close end)"), ("ret_6m", sql._ret(126, 0, "beidx", "beclose")), ("ret_1m", sql._ret(21, 0, "beidx", "beclose"))))
_REGIME = f"""{_P},
inputs as (select segment, {_STATES} from bpanel join bser using (segment, idx) cross join size group by 1),
states as (select *, case when from_high < 0.9 and ret_1m > 0.05 then 'reversal-risk' when from_high < 0.9 or ret_6m < 0 then 'caution' else 'normal' end as state from inputs)"""
_PLAIN = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _entity, _plain in (("&amp;", "&"), ("&#0?39;|&apos;|&rsquo;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_entity}', '{_plain}', 'g')"
_NUMBERS = r"regexp_extract_all(t, '(?s)&#\d+;|&|[^&]+')"
_PLAIN = f"""(select coalesce(string_agg(case when regexp_full_match(p, '&#\\d+;') then coalesce(case when n <= 1114111 and not n between 55296 and 57343 then chr(n::int) end, p) else p end, '' order by k), '')
  from (select p, k, try_cast(regexp_extract(p, '&#(\\d+);', 1) as bigint) as n from (select unnest(ps) as p, generate_subscripts(ps, 1) as k from (select {_NUMBERS} as ps from (select {_PLAIN} as t)))))"""


def _shown(value: str, digits: int, minus: str, plus: str, unit: str) -> str:
    return f"case when {value} is null then '—' else case when {value} < 0 then '{minus}' else '{plus}' end || {sql.digits(f'abs({value})', digits)} || '{unit}' end"


def _cap(value: str) -> str:
    steps = [(f"{value} >= {low}", sql.digits(f"({value}) / {unit}", digits), letter) for low, unit, digits, letter in ((1e12, 1e12, 2, "T"), (1e11, 1e9, 0, "B"), (1e9, 1e9, 1, "B"), (0, 1e6, 0, "M"))]
    return f"case when {value} is null or {value} <= 0 then '—' " + " ".join(f"when {test} then '$' || {text_} || '{letter}'" for test, text_, letter in steps) + " end"


_ISLANDS = f"""{_P}, seen as (select id, idx, case when idx - lag(idx) over (partition by id order by idx) > 5 then 1 else 0 end as jump from panel where close is not null),
seg as (select id, idx, sum(jump) over (partition by id order by idx) as segment_no from seen)
select id, segment_no::bigint as segment_no, min(idx) as first_idx, max(idx) as last_idx, count(*) as points from seg group by 1, 2 having count(*) >= 2"""
_REPEATS = """
with daily as (select l_suppkey as id, l_shipdate::date as date, max(l_extendedprice / l_quantity) as close from lineitem group by 1, 2),
cached as (select * from daily where date < date '1999-01-01'),
fetched as (
  select l_suppkey as id, l_shipdate::date as date, l_extendedprice / l_quantity * 2 as close, l_orderkey * 8 + l_linenumber as seq from lineitem
  where l_shipdate::date >= date '1999-01-01' - 30)"""

ENTRIES: dict[str, tuple[Query, str | None]] = {
    "rank_12_1": (rank_12_1, f"""{_U}, r as (select *, rank() over (order by ret_12_1 desc) as rank from uni where ret_12_1 is not null),
        q as (select id, rank() over (order by prior_ret_12_1 desc) as before from uni where prior_ret_12_1 is not null)
        select r.id, segment, sector, rank, ret_12_1 as value, before - rank as change from r left join q using (id)"""),
    "window_returns": _measures([f"ret_{slug(w)}" for w in WINDOWS]),
    "prior_returns": _measures([f"ret_{slug(w)}" for w in WINDOWS], "prior"),
    "realised_vol": _measures(["vol_3m", "vol_1y"]),
    "rank_vol": _measures([f"rank_vol_{slug(w)}" for w in RANK_WINDOWS]),
    "return_per_vol": _measures(["return_per_vol"]),
    "max_drawdown": _measures(["max_drawdown"]),
    "range_52": _measures(["low52", "high52"]),
    "series_extent": _measures(["first_idx", "last_idx", "days", "last"]),
    "beta_ols": _measures(["beta", "alpha", "r2", "pairs"]),
    "residual_return": _measures([f"res_{slug(w)}" for w in WINDOWS]),
    "residual_vol": _measures([f"res_vol_{slug(w)}" for w in RANK_WINDOWS]),
    "positive_day_share": _measures(["positive_days"]),
    "top_day_concentration": _measures(["top_days"]),
    "distance_from_high": _measures(["from_high"]),
    "time_near_high": _measures(["near_high"]),
    "downside_deviation": _measures(["downside"]),
    "prior_block": _measures([*(f"res_{slug(w)}" for w in WINDOWS), "vol_3m", "vol_1y", "return_per_vol"], "prior"),
    "daily_returns": (daily_returns, f"{_P} select id, idx, {r6('ret')} as ret from days where ret is not null"),
    "endpoints": (endpoints_every_day, f"{_P} select id, idx, eidx as end_idx, {r6('eclose')} as end_close from days"),
    "endpoints_every_day": (endpoints_every_day, f"{_P} select id, idx, eidx as end_idx, {r6('eclose')} as end_close from days"),
    "endpoints_thinned": (partial(endpoints_every_day, thin=True), sql.thinned(f"{_P} select id, idx, eidx as end_idx, {r6('eclose')} as end_close from days", THINNED_SQL)),
    "thinned_returns": _measures([*(f"ret_{slug(w)}" for w in WINDOWS), "vol_3m", "vol_1y", "max_drawdown"], thin=True),
    "thinned_regressions": _measures(["beta", "alpha", "r2", "pairs", *(f"res_vol_{slug(w)}" for w in RANK_WINDOWS)], thin=True),
    "thinned_paths": _measures(["from_high", "near_high", "positive_days", "downside", "top_days", "low52", "high52", "first_idx", "last_idx", "days", "last"], thin=True),
    "thinned_evidence": (partial(price_evidence, thin=True), sql.thinned(f"{_EVIDENCE} select * from ev", THINNED_SQL)),
    "thinned_islands": (partial(gap_islands, thin=True), sql.thinned(_ISLANDS, THINNED_SQL)),
    "series_dates": (series_dates, sql.thinned(f"{_P} select id, min(date) as first_date, max(date) as last_date, count(*) as days from panel where close is not null group by id", THINNED_SQL)),
    "returns_between": (returns_between, sql.thinned(f"""{_P}, b as (select id, id * 7 % 330 as start, idx, eidx, eclose from days),
        e as (select id, any_value(start) as start, max(case when idx = start then eidx end) as i, max(case when idx = start then eclose end) as x, max(case when idx = 300 then eidx end) as j, max(case when idx = 300 then eclose end) as y from b group by id)
        select id, {r6('case when start < 300 and j > i then y / x - 1 end')} as ret from e""", THINNED_SQL)),
    "no_history": (no_history, sql.thinned(f"{_P} select id, 'no-history' as reason from members where id not in (select id from obs)", THINNED_SQL)),
    "viewport": (viewport, f"{_U}, r as (select id, rank() over (order by ret_12_1 desc) as rank, ret_12_1 as value from uni where ret_12_1 is not null) select id, rank, value from r order by rank, id limit 28 offset 12"),
    "calendar_orphans": (calendar_orphans, f"{_P} select id, count(*) as orphans from obs where date not in (select date from cal where idx % 2 = 0) group by 1"),
    "forward_index": (forward_index, f"{_P} select d.date, min(idx) as idx from (select distinct o_orderdate::date as date from orders) d join cal on cal.date >= d.date group by 1"),
    "gap_islands": (gap_islands, _ISLANDS),
    "stream_rolling": (stream_rolling, f"""with d as (select user_id as id, ts::date as date, arg_max(value, event_id) as close from events group by 1, 2),
        r as (select *, row_number() over (partition by id order by date desc) as k from d)
        select id, count(*) as days, max(date) as last_date, {r6('max(case when k = 1 then close end)')} as last_close, {r6('max(case when k <= 6 then close end)')} as high,
          {r6("regr_slope(close, date - date '2000-01-01')")} as slope from r group by 1"""),
    "events_view_before_click": (events_view_before_click, """select c.event_id, v.event_id as view_id, v.value as view_value
        from (select * from events where event_type = 'click') c asof left join (select * from events where event_type = 'view') v on v.user_id = c.user_id and v.ts <= c.ts"""),
    "events_error_after_view": (events_error_after_view, """select v.event_id, case when e.ts - v.ts <= interval 6 hour then e.event_id end as error_id
        from (select * from events where event_type = 'view') v asof left join (select * from events where event_type = 'error') e on e.ts >= v.ts"""),
    "horizon_tail": (horizon_tail, f"{_P} select id, idx, floor(close * 1e4 + 0.5) / 1e4 as close from panel cross join size where idx >= anchor - 63 and close is not null"),
    "universe_prior_cap": (lambda s, d: universe(s, d).select("id", "market_cap", "prior_market_cap"), f"{_U} select id, market_cap, prior_market_cap from uni"),
    **{f"screen_{m.id.replace('-', '_').lower()}": _screen(ranking.Screen(m.id)) for m in registry.ALL},
    "screen_inverted": _screen(ranking.Screen("12-1", invert=True)),
    "screen_filtered": _screen(ranking.Screen("3M", segment="ASIA", query="supplier"), "segment = 'ASIA' and upper(name) like '%SUPPLIER%'"),
    "screen_watchlist": _screen(ranking.Screen("volatility", watchlist_only=True), "id between 1 and 40"),
    "sector_leaders": (sector_leaders, f"""{_U}, c as (select *, rank() over (partition by segment, sector order by ret_12_1 desc) as a, rank() over (partition by segment, sector order by ret_6_1 desc) as b,
          count(*) over (partition by segment, sector) as of from uni where ret_12_1 is not null and ret_6_1 is not null)
        select segment, sector, id, (a + b) / 2 as average_rank, of from (select *, row_number() over (partition by segment, sector order by (a + b) / 2, ret_12_1 desc, id) as place from c) where place = 1"""),
    "empty_slots": (empty_slots, f"{_U} select r_name as segment, n_name as sector from region, nation where (r_name, n_name) not in (select (segment, sector) from uni where ret_12_1 is not null and ret_6_1 is not null)"),
    "distinct_sectors": (distinct_sectors, "select distinct n_name as sector from supplier join nation on s_nationkey = n_nationkey where n_name <> ''"),
    "group_summary": (group_summary, f"""{_U} select segment, count(*) as count, count(ret_12_1) as measured, count(*) filter (ret_12_1 > 0) as positive, count(*) filter (ret_12_1 < 0) as negative,
        count(*) filter (ret_12_1 = 0) as flat, {r6('avg(ret_12_1)')} as mean, {r6('quantile_cont(ret_12_1, 0.5)')} as median,
        {r6('case when count(ret_12_1) >= 4 then quantile_cont(ret_12_1, 0.75) - quantile_cont(ret_12_1, 0.25) end')} as spread,
        arg_max(id, (ret_12_1, -id)) filter (ret_12_1 is not null) as best, arg_min(id, (ret_12_1, id)) filter (ret_12_1 is not null) as worst from uni group by 1"""),
    "sector_hhi": (sector_hhi, f"""with c as (select n_name as sector, count(*) as count from supplier join nation on s_nationkey = n_nationkey group by 1),
        s as (select *, count / sum(count) over () as share from c) select sector, count, {r6('share')} as share, {r6('sum(share * share) over ()')} as hhi from s"""),
    "segment_counts": (segment_counts, "select r_name as segment, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name)"),
    "coverage_share": (coverage_share, f"{_U} select {r6('avg((vol_1y is not null)::int)')} as share from uni"),
    "segment_subtotals": (segment_subtotals, f"""with x as (select r_name as segment, greatest(0.0, s_acctbal)::decimal(18,2) as a from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
        g as (select segment, sum(a) as amount, max(a) as largest from x group by 1) select segment, amount::double as amount, largest::double as largest, {r6('amount::double / (sum(amount) over ())::double')} as share from g"""),
    "range_position": (range_positions, f"{sql.MEASURED} select id, floor((last - low52) / (high52 - low52) * 100 * 1e4 + 0.5) / 1e4 as position from m where moment = 'now' and high52 > low52 union all select id, null from m where moment = 'now' and not coalesce(high52 > low52, false)"),
    "sync_days": (sync_days, f"{_SYNC} select distinct idx from syn"),
    "correlation_pairs": (correlation_pairs, f"{_SYNC} select a.id as i, b.id as j, count(*) as days, {r6('corr(a.ret, b.ret)')} as correlation from syn a join syn b on a.idx = b.idx and a.id < b.id group by 1, 2"),
    "correlation_matrix": (correlation_matrix, f"{_SYNC} select a.id as i, b.id as j, {r6('case when a.id = b.id then 1.0 else corr(a.ret, b.ret) end')} as correlation from syn a join syn b on a.idx = b.idx group by 1, 2"),
    "avg_correlation": (average_correlation, f"{_SYNC}, c as (select corr(a.ret, b.ret) as r from syn a join syn b on a.idx = b.idx and a.id < b.id group by a.id, b.id) select {r6('avg(r)')} as correlation from c"),
    "covariance_pairs": (covariance_pairs, f"{_COV} select i, j, {r6('cov')} as cov from cov"),
    "shrunk_covariance": (shrunk_covariance, f"{_COV} select i, j, {r6('cov')} as cov from shr"),
    "correlation_distance": (correlation_distance, f"{_COV} select i, j, {r6('case when i = j then 0.0 else sqrt(greatest(0.0, (1 - cov / (a.s * b.s)) / 2)) end')} as distance from shr join sd a on a.id = i join sd b on b.id = j"),
    "alloc_equal": (allocation_equal, f"{_COV}, w as (select i as id, 1.0::double / count(*) over () as weight from shr where i = j){_RISK}"),
    "alloc_inverse_vol": (allocation_inverse_vol, f"{_COV}, inv as (select i as id, 1 / sqrt(cov) as x from shr where i = j), w as (select id, x / sum(x) over () as weight from inv){_RISK}"),
    "alloc_hrp": (_allocated("hrp"), None),
    "alloc_capped": (_allocated("inverse-vol", 0.12, 0.38), None),
    "alloc_inverse_vol_tight": (_allocated_flat("inverse-vol", *TIGHT), allocation_sql.allocated(_COV, _RISK, allocation_sql.INVERSE_VOLATILITY, *TIGHT)),
    "alloc_parity": (_allocated_flat("hrp"), allocation_sql.allocated(_COV, _RISK, allocation_sql.RISK_PARITY, None, None)),
    "alloc_parity_tight": (_allocated_flat("hrp", *TIGHT), allocation_sql.allocated(_COV, _RISK, allocation_sql.RISK_PARITY, *TIGHT)),
    "cash_amounts": (cash_amounts, """with x as (select s_suppkey as id, r_name as segment, greatest(0.0, s_acctbal) as w from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
        e as (select *, w / sum(w) over (partition by segment) * 100000 as exact from x),
        p as (select *, floor(100000 - sum(floor(exact)) over (partition by segment) + 0.5) as rest, row_number() over (partition by segment order by exact - floor(exact) desc, id) as place from e)
        select id, segment, (floor(exact) + case when place <= rest then 1 else 0 end)::bigint as amount from p"""),
    "market_regime": (market_regime, f"{_REGIME} select segment, from_high, ret_6m, ret_1m, state from states"),
    "regime_banner": (regime_banner, f"""{_REGIME}, b as (select *, (floor((1 - from_high) * 100 + 0.5))::bigint || '%' as below from states)
        select segment, case when state = 'reversal-risk' then 'Bear rally: ' || below || ' off the peak, last month sharply up'
          when state = 'caution' and from_high < 0.9 then 'Drawn down: ' || below || ' off the peak'
          when state = 'caution' then 'Weak half-year: lower than six months ago' else 'Calm: close to the peak, half-year not negative' end as banner from b"""),
    "earnings_latest": (earnings_latest, f"{_P}{sql.EVENTS} select id, date, {r6('eps_actual')} as eps_actual, {r6('eps_estimated')} as eps_estimated, {r6('surprise')} as surprise, {r6('since_return')} as since_return from latest"),
    "merge_last_wins": (merge_last_wins, f"{_MERGE} select id, date, {r6('coalesce(f.close, c.close)')} as close from cached c full join fetched f using (id, date) where date >= date '1996-01-01'"),
    "merge_first_wins": (merge_first_wins, f"{_MERGE} select id, date, {r6('coalesce(c.close, f.close)')} as close from cached c full join fetched f using (id, date) where date >= date '1996-01-01'"),
    "cache_merge": (cache_merge, _CACHE),
    "cache_lookup": (cache_lookup, f"select * from ({_CACHE}) where id in (5, 11, 12, 10000000)"),
    "sql_ranges": (sql_ranges, f"""select id, count(*) as days, {r6('case when max(close) > min(close) then (arg_max(close, date) - min(close)) / (max(close) - min(close)) * 100 end')} as position
        from (select id, date, close from ({_RAW_CACHE})) where date >= date '1997-01-01' group by id"""),
    "sql_one_id": (sql_one_id, f"select id, idx, close from ({_PUBLISHED}) where id = 7"),
    "published_series": (published_series, _PUBLISHED),
    "fetch_bounds": (fetch_bounds, f"{_MERGE} select id, greatest(max(date) - 7, date '1998-12-28')::date as fetch_from from cached group by 1"),
    "merge_last_of_repeats": (merge_last_of_repeats, f"""{_REPEATS}, f as (select id, date, arg_max(close, seq) as close from fetched group by 1, 2)
        select id, date, {r6('coalesce(f.close, c.close)')} as close from cached c full join f using (id, date) where date >= date '1996-01-01'"""),
    "merge_first_of_repeats": (merge_first_of_repeats, f"""{_REPEATS}, f as (select id, date, arg_min(close, seq) as close from fetched group by 1, 2)
        select id, date, {r6('coalesce(c.close, f.close)')} as close from cached c full join f using (id, date) where date >= date '1996-01-01'"""),
    "refresh_failures": (refresh_failures, f"""{_MERGE}, o as (select id, count(*) as n from cached group by 1), f as (select id, count(*) as n from fetched where id % 5 <> 0 group by 1),
        t as (select id, count(*) as n from (select id, date from cached union select id, date from fetched where id % 5 <> 0) group by 1), e as (select s_suppkey as id from supplier where s_suppkey % 10 = 0)
        select id, case when e.id is not null then 0 else greatest(0, t.n - coalesce(o.n, 0)) end as added, case when e.id is not null then coalesce(o.n, 0) else t.n end as total,
          e.id is not null or (coalesce(f.n, 0) = 0 and coalesce(o.n, 0) > 0) as stale, case when e.id is not null then 'status 500' end as error
        from t full join e using (id) left join o using (id) left join f using (id)"""),
    "refresh_outcomes": (refresh_outcomes, f"""{_MERGE}, o as (select id, count(*) as n from cached group by 1), f as (select id, count(*) as n from fetched where id % 5 <> 0 group by 1),
        t as (select id, count(*) as n from (select id, date from cached union select id, date from fetched where id % 5 <> 0) group by 1)
        select id, greatest(0, t.n - coalesce(o.n, 0)) as added, t.n as total, coalesce(f.n, 0) = 0 and coalesce(o.n, 0) > 0 as stale from t left join o using (id) left join f using (id)"""),
    "fetch_tiles": (fetch_tiles, """with d as (select min(o_orderdate)::date as low, max(o_orderdate)::date as high from orders)
        select s::date as start, least(s::date + 13, high) as end from (select unnest(generate_series(low::timestamp, high::timestamp, interval 14 day)) as s, high from d)"""),
    "segment_conflicts": (segment_conflicts, _CONFLICTS),
    "price_evidence": (price_evidence, f"{_EVIDENCE} select * from ev"),
    "share_classes": (share_classes, f"""{_EVIDENCE}, r as (select m.name as ticker, m.sector, observations, staleness, market_cap,
          case when coalesce(observations, 0) = 0 then 'no-history' when staleness > 21 then 'stale:' || staleness end as reason
          from members m left join ev using (id)),
        p as (select *, row_number() over w as place, first_value(ticker) over w as win from r window w as (partition by sector, reason is null order by staleness, observations desc, market_cap desc, ticker))
        select ticker, case when reason is null and place > 1 then 'same-company:' || win else reason end as reason from p"""),
    "capped_members": (capped_members, "select segment, id from (select r_name as segment, s_suppkey as id, row_number() over (partition by r_name order by s_suppkey) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) where n <= 3"),
    "holdings_enriched": (holdings_enriched, """select s_name as ticker, case when s_suppkey % 2 = 0 then 'Name of ' || s_name else s_name end as name, case when s_suppkey % 2 = 0 then n_name else 'Unknown' end as sector,
        case when s_suppkey % 2 = 0 then r_name else 'Unknown' end as industry from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "validation_issues": (validation_issues, f"""{_U}
        select 'error' as level, id::varchar as subject, 'benchmark-mismatch' as issue from uni where id % 9 = 0
        union all select 'error', id::varchar, 'close-not-positive' from uni where id % 13 = 0
        union all select 'error', 'all', 'rows-below:900' from uni having count(*) < 900
        union all select 'error', 'all', 'coverage-below:ret_12_1:75%' from uni having avg((ret_12_1 is not null)::int) < 0.75
        union all select 'warning', 'all', 'coverage-below:beta:60%' from uni having avg((beta is not null)::int) < 0.6
        union all select 'warning', 'all', 'stale-above:10%' from uni having avg((id % 4 = 0)::int) > 0.1
        union all select 'error', x, 'segment-empty' from (values ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST'), ('NOWHERE')) v(x) where x not in (select segment from uni)"""),
    "watchlist_order": (watchlist_order, "select place, s_suppkey as id, s_name as name from (values (0, 7), (1, 3), (2, 9), (3, 10000000), (4, 1)) w(place, k) join supplier on s_suppkey = k"),
    "tickers": (tickers, "select c_custkey, upper(replace(replace(c_name, '#', '.'), '.', '-')) as ticker from customer"),
    "company_keys": (company_keys, "select c_custkey, lower(c_mktsegment) as company from customer"),
    "canonical_sectors": (canonical_sectors, "select p_partkey, (['Information Technology', 'Materials', 'Energy', 'Unknown', 'Real Estate', 'Unknown'])[p_partkey % 6 + 1] as sector from part"),
    "last_quotes": (last_quotes, "select o_custkey::varchar as symbol, arg_max(o_orderpriority, o_orderkey) as name, arg_max(o_totalprice, o_orderkey) as price from orders group by 1"),
    "page_text": (page_text, f"select page_id, md5(regexp_replace(regexp_replace({_PLAIN}, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')) as text_md5 from pages"),
    "formatted": (formatted, f"{_U} select id, {_shown('ret_12_1 * 100', 1, '−', '+', '%')} as ret, {_shown('beta', 2, '-', '', '')} as beta, {_cap('market_cap')} as cap, {_cap('market_cap * 1e8')} as cap_of_bonds from uni"),
}
ENTRIES |= provider_queries.entries(universe)
#: The portfolio's queries under the names that they had when the plain ones held some of the brands.
PORTFOLIO = ["sync_days", "correlation_pairs", "correlation_matrix", "avg_correlation", "covariance_pairs", "shrunk_covariance", "correlation_distance", "alloc_equal", "alloc_inverse_vol", "alloc_hrp", "alloc_capped"]
ENTRIES |= {f"{name}_all_brands": ENTRIES[name] for name in PORTFOLIO}
QUERIES = {name: run for name, (run, _) in ENTRIES.items()}
ORACLE_SQL = {name: text_ for name, (_, text_) in ENTRIES.items() if text_}
