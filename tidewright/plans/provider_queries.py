"""Queries that read the star schema as provider answers: scans, the announcements' store, and all number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import formats
from tidewright.operators import measures
from tidewright.plans import oracle as sql
from tidewright.plans.oracle import r6
from tidewright.schema import EARNINGS_RETENTION_DAYS
from tidewright.scratch import kept, new_path
from tidewright.sources import adapters, readers
from tidewright.sources.sinks import rounded, rounded_frame
from tidewright.sources.stores import EarningsStore

#: Labels as providers write them, and what they stand for.
LABELS = (" Technology ", "Basic Materials", "ENERGY", "Crypto", "Real Estate")
SECTORS = "['Information Technology', 'Materials', 'Energy', 'Unknown', 'Real Estate', 'Unknown']"


def label(key: str) -> Column:
    """A provider's label of a row; every sixth has none."""
    return F.get(F.array(*map(F.lit, LABELS)), (F.col(key) % 6).cast("int"))


def constituents_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an index list; a symbol is missing where the size is 7, a sub-sector where it is 9."""
    p = adapters.read(spark, sf_dir, "part")
    symbol = F.when(F.col("p_size") != 7, F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit("\n")))
    raw = p.select("p_partkey", symbol.alias("symbol"), F.concat(F.lit("  "), "p_type").alias("name"), label("p_partkey").alias("sector"), F.when(F.col("p_size") != 9, F.col("p_type")).otherwise("").alias("subSector"))
    return readers.constituents(raw, ["p_partkey"])


def holdings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a fund's holdings: every third names no asset, every seventh nothing at all."""
    s = adapters.read(spark, sf_dir, "supplier")
    asset = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    symbol = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("alt."), F.col("s_suppkey").cast("string")))
    return readers.holdings(s.select(asset.alias("asset"), symbol.alias("symbol"), F.col("s_name").alias("name")))


def adjusted_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as closes in text: some with no date, some not above zero, many for one day."""
    lines = adapters.read(spark, sf_dir, "lineitem")
    date = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.to_date("l_shipdate").cast("string"))
    close = F.when(F.col("l_linenumber") == 6, "-1").when(F.col("l_linenumber") == 5, "none").otherwise(F.col("l_extendedprice").cast("string"))
    raw = lines.select(F.col("l_suppkey").alias("id"), date.alias("date"), close.alias("close"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return readers.adjusted_closes(raw)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as announcements of their customers."""
    o = adapters.read(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("c."), F.col("o_custkey").cast("string")).alias("symbol"), F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("epsActual"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("x").alias("epsEstimated"), F.lit(None).cast("string").alias("revenueActual"), F.lit("1e3").alias("revenueEstimated"), F.col("o_orderkey").alias("seq"),
    )


def provider_earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each customer and day."""
    return readers.earnings(_answers(spark, sf_dir))


def earnings_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements fetched in tiles up to ten days before the last order, then up to it: the second fetch changes nothing that is stored."""
    raw = _answers(spark, sf_dir)
    last = adapters.read(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")), F.date_sub(F.to_date(F.max("o_orderdate")), 10)).first()
    store = EarningsStore(spark, new_path(spark, "announcements"))
    for today, factor in ((last[1], 1.0), (last[0], 2.0)):
        store.refresh(today, lambda a, b, by=factor: readers.earnings_between(raw, a, b).withColumn("eps_actual", F.col("eps_actual") * by).withColumn("seq", F.lit(0)))
    return store.read()[1].select("id", "date", "eps_actual")


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an index table of each nation's suppliers, and the rows read back from them."""
    s = adapters.members(spark, sf_dir)
    letters = F.translate(F.col("id").cast("string"), "0123456789", "ABCDEFGHIJ")
    cells = F.concat_ws("", *[F.concat(F.lit("<td class='c'>"), c, F.lit("</td>")) for c in (letters, F.concat(F.lit("<b>"), F.col("name"), F.lit("</b> &amp; Co")), F.coalesce(label("id"), F.lit("None")), F.col("segment"))])
    rows = s.select(F.col("sector").alias("page"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row"))
    table = F.array_join(F.sort_array(F.collect_list("row")), "\n")
    pages = rows.groupBy("page").agg(F.concat(F.lit("<table id=\"constituents\"><tr><th>Symbol</th></tr>"), table, F.lit("</table><p>")).alias("html"))
    return readers.constituents_table(kept(pages, "pages"))


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number format over a column of both signs."""
    o = adapters.read(spark, sf_dir, "orders").withColumn("v", (F.col("o_totalprice") - 150_000) / 64)
    v = F.col("v")
    return o.select(
        "o_orderkey", formats.percent_plain_column(v).alias("plain"), formats.spread_column(v).alias("spread"), formats.signed_ratio_column(v).alias("signed_ratio"), formats.integer_column(v).alias("whole"),
        formats.signed_integer_column(v).alias("signed_whole"), formats.cash_column(F.abs(v)).alias("cash"), formats.sign_column(v).alias("sign"), rounded(formats.meter_column(v / 1000)).alias("meter"), formats.display_date(F.to_date("o_orderdate")).alias("day"),
    )


def annualised(universe):  # noqa: ANN001, ANN201 (a function of session and folder)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded_frame(universe(spark, sf_dir).select("id", measures.annualise(F.col("ret_12m"), F.col("days")).alias("annualised")))

    return run


_V = "(o_totalprice - 150000) / 64"
_WHOLE = "floor(v + 0.5)::bigint"
_ANSWERS = "select 'C-' || o_custkey as id, o_orderdate::date as date, o_totalprice as eps_actual, case when o_orderkey % 2 = 0 then o_totalprice end as eps_estimated, o_orderkey as seq from orders"
ENTRIES = {
    "constituents_scan": (constituents_scan, f"""select p_partkey, upper(replace(p_brand, '#', '-')) as ticker, p_type as name, ({SECTORS})[p_partkey % 6 + 1] as sector,
        case when p_size = 9 then 'Unknown' else p_type end as industry from part where p_size <> 7"""),
    "holdings_scan": (holdings_scan, """select upper(case when s_suppkey % 3 <> 0 then s_name else 'alt-' || s_suppkey end) as ticker, s_name as name from supplier where s_suppkey % 3 <> 0 or s_suppkey % 7 <> 0"""),
    "adjusted_closes": (adjusted_closes, """select l_suppkey as id, l_shipdate::date as date, arg_max(l_extendedprice, l_orderkey * 8 + l_linenumber) as close from lineitem
        where l_linenumber < 5 and l_extendedprice > 0 group by 1, 2"""),
    "provider_earnings": (provider_earnings, f"""select id, date, arg_max(eps_actual, seq) as eps_actual, case when max(seq) % 2 = 0 then arg_max(eps_actual, seq) end as eps_estimated, null::double as revenue_actual, 1000.0::double as revenue_estimated
        from ({_ANSWERS}) group by 1, 2"""),
    "earnings_store": (earnings_store, f"""with a as ({_ANSWERS}), d as (select max(o_orderdate)::date as today from orders),
        f as (select id, date, arg_min(eps_actual, seq) as x from a group by 1, 2)
        select id, date, case when date <= today - 10 then x else x * 2 end as eps_actual from f, d where date between today - {EARNINGS_RETENTION_DAYS} and today"""),
    "index_tables": (index_tables, f"""select n_name as page, translate(s_suppkey::varchar, '0123456789', 'ABCDEFGHIJ') as ticker, s_name || ' & Co' as name, ({SECTORS})[s_suppkey % 6 + 1] as sector, r_name as industry
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "shown_values": (shown_values, f"""select o_orderkey, case when v < 0 then '-' else '' end || {sql.digits('abs(v * 100)', 1)} || '%' as plain, {sql.digits('abs(v) * 100', 1)} || '%' as spread,
        case when v >= 0 then '+' else '−' end || {sql.digits('abs(v)', 2)} as signed_ratio, format('{{:,}}', {_WHOLE}) as whole,
        case when {_WHOLE} = 0 then '0' else case when v >= 0 then '+' else '−' end || abs({_WHOLE})::varchar end as signed_whole, '$' || format('{{:,}}', floor(abs(v) + 0.5)::bigint) as cash,
        sign(v)::int as sign, {r6('least(1.0, greatest(0.0, (v / 1000 - 0.75) / 0.25)) * 100')} as meter, strftime(o_orderdate::date, '%-d %b %Y') as day from (select *, {_V} as v from orders)"""),
}


def entries(universe) -> dict:  # noqa: ANN001 (the engine's, which must not be imported here)
    annual = f"{sql.UNIVERSE} select id, {r6('case when days > 0 and 1 + ret_12m > 0 then pow(1 + ret_12m, 252.0 / days) - 1 end')} as annualised from uni"
    return {**ENTRIES, "annualised_returns": (annualised(universe), annual)}
