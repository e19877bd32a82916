"""Scans: provider payloads, index tables in HTML, published datasets, caches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators.series import usable
from tidewright.scratch import kept, local_table
from tidewright.sources import stores
from tidewright.sources.provider import Transport, fetched

#: The patterns of a date, of an index table with its rows and cells, and of a symbol in it.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
TABLE = r'(?s)id="constituents"(.*?)(?:</table>|.\z)'
ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
CELL = r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"
SYMBOL = r"^[A-Z][A-Z.-]{0,6}$"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records under a given schema; a malformed record becomes nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def constituents(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(ticker, name, sector, industry) and the columns ``keep``, from (symbol, name, sector, subSector); no empty symbol."""
    rows = raw.select(*keep, text.ticker(F.col("symbol")).alias("ticker"), text.trimmed(F.col("name")).alias("name"), text.sector(F.col("sector")).alias("sector"), F.coalesce(text.text_or_null(F.col("subSector")), F.lit("Unknown")).alias("industry"))
    return rows.where(F.coalesce("ticker", F.lit("")) != "")


def holdings(raw: DataFrame) -> DataFrame:
    """(ticker, name) of a fund, from (asset, symbol, name)."""
    t = text.ticker(F.coalesce("asset", "symbol", F.lit("")))
    return raw.select(t.alias("ticker"), F.col("name")).where("ticker <> ''")


def fund(raw: DataFrame | None) -> DataFrame | None:
    """``holdings`` of a fund's answer, or None where the request failed or named nothing: the next source is tried."""
    if raw is None:
        return None
    found = holdings(raw)
    return None if found.isEmpty() else found


def quotes(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a symbol, the last by ``seq``: (symbol, name, price, market_cap, exchange, year_low, year_high)."""
    names = {"price": "price", "marketCap": "market_cap", "yearLow": "year_low", "yearHigh": "year_high"}
    row = F.struct(F.col("name"), F.col("exchange"), *[text.number_or_null(F.col(a).cast("string")).alias(b) for a, b in names.items()])
    return raw.groupBy("symbol").agg(F.max_by(row, F.col(seq)).alias("q")).select("symbol", "q.*")


def adjusted_closes(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, date, close) of usable closes with a proper date; of equal days the last by ``seq``."""
    rows = raw.where(F.col("date").rlike(ISO_DATE)).withColumn("close", text.number_or_null(F.col("close").cast("string")))
    rows = rows.withColumn("day", F.try_to_date("date")).where(F.col("day").isNotNull() & usable(F.col("close")))
    return rows.groupBy("id", F.col("day").alias("date")).agg(F.max_by("close", F.col(seq)).alias("close"))


def earnings(raw: DataFrame, seq: str = "seq", last: bool = True) -> DataFrame:
    """(id, date, eps_actual, eps_estimated, revenue_actual, revenue_estimated), one row a symbol and day."""
    numbers = {"epsActual": "eps_actual", "epsEstimated": "eps_estimated", "revenueActual": "revenue_actual", "revenueEstimated": "revenue_estimated"}
    rows = raw.where(F.col("date").rlike(ISO_DATE)).withColumn("day", F.try_to_date("date")).withColumn("id", text.ticker(F.col("symbol")))
    row = F.struct(*[text.number_or_null(F.col(a).cast("string")).alias(b) for a, b in numbers.items()])
    pick = F.max_by if last else F.min_by
    return rows.where("day is not null and id <> ''").groupBy("id", F.col("day").alias("date")).agg(pick(row, F.col(seq)).alias("e")).select("id", "date", "e.*")


def earnings_between(raw: DataFrame, start: dt.date, end: dt.date, seq: str = "seq") -> DataFrame:
    """``earnings`` of all symbols with a date from ``start`` to ``end``; of equal days the first row."""
    return earnings(raw, seq, last=False).where(F.col("date").between(F.lit(start), F.lit(end)))


def constituents_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """(pages' columns, ticker, name, sector, industry): the rows of the table with id ``constituents``.

    A page without that table has no rows here; ``missing_tables`` lists such pages. The table ends at
    the first closing tag, or with the page; rows need three cells and a symbol of capitals.
    """
    table = F.regexp_extract(F.col(html), TABLE, 1)
    rows = F.regexp_extract_all(table, F.lit(ROW), 1)

    def cells(row: Column) -> Column:
        raw = F.regexp_extract_all(row, F.lit(CELL), 1)
        return F.transform(raw, lambda c: text.trimmed(text.decoded(F.regexp_replace(c, "<[^>]*>", ""))))

    other = [c for c in pages.columns if c != html]
    split = pages.select(*other, F.explode(F.transform(rows, cells)).alias("cells"))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    good = split.where((cell(0) != "") & (cell(1) != "") & (cell(2) != "") & cell(0).rlike(SYMBOL))
    return good.select(*other, text.ticker(cell(0)).alias("ticker"), cell(1).alias("name"), text.sector(cell(2)).alias("sector"), F.when(cell(3) == "", "Unknown").otherwise(cell(3)).alias("industry"))


def missing_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.where(~F.coalesce(F.col(html).contains('id="constituents"'), F.lit(False)))


def require_tables(pages: DataFrame, key: str = "segment", html: str = "html") -> None:
    """An error if a page has no index table."""
    lost = missing_tables(pages, html).select(key).limit(5).collect()
    if lost:
        raise ValueError(f"no index table for {', '.join(str(r[0]) for r in lost)}")


def index_pages(spark: SparkSession, paths: Mapping[str, str], transport: Transport) -> DataFrame:
    """(segment, ticker, name, sector, industry): the index tables of the pages at ``paths``, fetched; a page without one is an error."""
    columns = {"segment": pa.array(list(paths)), "path": pa.array(list(paths.values()))}
    asked = local_table(spark, columns).withColumn("params", F.create_map().cast("map<string,string>"))
    pages = kept(fetched(asked, transport, 1, raw=True).select("segment", F.col("body").alias("html"), "error"), "index-pages")
    failed = pages.where("error is not null").select("segment", "error").collect()  # one row a segment
    if failed:
        raise ValueError(f"segment {failed[0]['segment']}: {failed[0]['error']}")
    pages = pages.select("segment", "html")
    require_tables(pages)
    return constituents_table(pages)


def plain_text(html: Column) -> Column:
    """Without tags, entities decoded."""
    return text.trimmed(text.decoded(F.regexp_replace(html, "<[^>]*>", "")))


def dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, universe) of the version that the pointer of a published dataset names."""
    at = stores.current(spark, root)
    if at is None:
        raise FileNotFoundError(root)
    return spark.read.json(f"{at}/manifest"), spark.read.parquet(f"{at}/universe")


def all_series(spark: SparkSession, root: str) -> DataFrame:
    """Every series of the version that the pointer names, with the partition of its id."""
    at = stores.current(spark, root)
    if at is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{at}/series")


def series(spark: SparkSession, root: str, ids: Sequence | DataFrame) -> DataFrame:
    """The series of some ids; unknown ids have no rows.

    Series are partitioned by a hash of the id, so a list of ids opens only their partitions' files.
    """
    at = stores.current(spark, root)
    if at is None:
        raise FileNotFoundError(root)
    found = spark.read.parquet(f"{at}/series")
    if isinstance(ids, DataFrame):
        return found.join(ids.select("id"), "id", "left_semi").drop(stores.PART)
    parts = stores.parts_of(spark, ids, found.schema["id"].dataType)
    return found.where(F.col(stores.PART).isin(*parts) & F.col("id").isin(*ids)).drop(stores.PART)
