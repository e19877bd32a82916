"""Tables of a star schema as the data model: suppliers are securities, weeks trading days.

A close is the week's revenue over its quantity; sums run in decimals, so order does not matter.
Segments are regions, each region's own unit price is its benchmark, sectors are nations, the
account balance stands for the market value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task groups, about.
GROUPED_ROWS = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, segment, sector, market_cap)."""
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("r_name").alias("segment"),
        F.col("n_name").alias("sector"), F.col("s_acctbal").alias("market_cap"),
    )


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, n of them, in as many parts by their keys as they ask for.

    Where groups have few rows each, grouping before the exchange saves little and holds about every group of a
    task's input, which grows with the table; after this one a task holds the groups of GROUPED_ROWS rows.
    """
    return rows.repartition(max(1, -(-n // GROUPED_ROWS)), *keys)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, date, paid, quantity): one row a supplier and week, in decimals."""
    lines = read(spark, sf_dir, "lineitem")
    paid, quantity = (F.col(c).cast("decimal(18,2)") for c in ("l_extendedprice", "l_quantity"))
    rows = lines.select(F.col("l_suppkey").alias("id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), paid.alias("paid"), quantity.alias("quantity"))
    return dealt(rows, lines.count(), "id", "date").groupBy("id", "date").agg(F.sum("paid").alias("paid"), F.sum("quantity").alias("quantity"))


def _price(paid: F.Column, quantity: F.Column) -> F.Column:
    return paid.cast("double") / quantity.cast("double")


def observations(weeks: DataFrame) -> DataFrame:
    """(id, date, close) from ``weekly``."""
    return weeks.select("id", "date", _price(F.col("paid"), F.col("quantity")).alias("close"))


def benchmark_observations(weeks: DataFrame, members_: DataFrame) -> DataFrame:
    """(id, date, close) with segments as ids, from ``weekly``."""
    joined = weeks.join(members_.select("id", "segment"), "id")
    summed = joined.groupBy("segment", "date").agg(F.sum("paid").alias("paid"), F.sum("quantity").alias("quantity"))
    return summed.select(F.col("segment").alias("id"), "date", _price(F.col("paid"), F.col("quantity")).alias("close"))


def brand_observations(spark: SparkSession, sf_dir: str, brands: list[str] | None = None) -> DataFrame:
    """(id, date, close) with brands as ids: denser series than suppliers have. brands: only these."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    if brands is not None:
        parts = parts.where(F.col("p_brand").isin(*brands))
    lines = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    sums = lines.groupBy(F.col("p_brand").alias("id"), week.alias("date")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("paid"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity")
    )
    return sums.select("id", "date", _price(F.col("paid"), F.col("quantity")).alias("close"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, date, eps_actual, eps_estimated): a supplier's quarter, dated at its last shipment."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    quarter = F.date_trunc("quarter", "l_shipdate")
    paid, guess = F.col("l_extendedprice").cast("decimal(18,2)"), (F.col("l_quantity") * F.col("p_retailprice")).cast("decimal(18,2)")
    return (
        lines.groupBy(F.col("l_suppkey").alias("id"), quarter.alias("quarter"))
        .agg(F.to_date(F.max("l_shipdate")).alias("date"), F.sum(paid).cast("double").alias("a"), F.sum(guess).cast("double").alias("e"), F.count(F.lit(1)).alias("n"))
        .select("id", "date", (F.col("a") / F.col("n")).alias("eps_actual"), (F.col("e") / F.col("n")).alias("eps_estimated"))
    )
