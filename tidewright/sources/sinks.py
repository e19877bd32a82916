"""Sinks: rounding, series from their first close on, and versioned publication with one atomic switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import validation
from tidewright.sources import stores

DIGITS, SERIES_DIGITS = 6, 4


def rounded(c: Column, digits: int = DIGITS) -> Column:
    """Half up towards positive infinity; null, NaN and infinite values stay."""
    scale = float(10**digits)
    finite = ~F.isnan(c) & (F.abs(c) < 1e15)
    return F.when(finite, F.floor(c * scale + 0.5) / scale).otherwise(c)


def rounded_frame(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    scale = f"{10**digits}.0D"
    half_up = lambda c: F.expr(f"case when not isnan(`{c}`) and abs(`{c}`) < 1e15D then floor(`{c}` * {scale} + 0.5D) / {scale} else `{c}` end as `{c}`")
    return df.select(*[half_up(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def without_leading_gaps(panel: DataFrame) -> DataFrame:
    """The panel from each id's first close on, at four digits; inner gaps stay null."""
    first = F.min(F.when(F.col("close").isNotNull(), F.col("idx"))).over(Window.partitionBy("id"))
    kept = panel.withColumn("first", first).where(F.col("idx") >= F.col("first")).drop("first")
    return kept.withColumn("close", rounded(F.col("close"), SERIES_DIGITS))


def publish(universe: DataFrame, series: DataFrame, manifest: DataFrame, root: str, issues: DataFrame | None = None) -> str:
    """Write a new version and switch the pointer to it; readers see the old one or the new one.

    issues: of ``validation.validate``; with an error among them nothing is written.
    """
    if issues is not None and validation.has_errors(issues):
        worst = issues.where("level = 'error'").limit(5).collect()
        raise ValueError("nothing published: " + ", ".join(f"{r['subject']} {r['issue']}" for r in worst))
    spark = universe.sparkSession
    version = stores.new_version()
    rounded_frame(universe).write.parquet(f"{root}/{version}/universe")
    stores.write_parts(without_leading_gaps(series), f"{root}/{version}/series", ["id", "idx"])
    manifest.coalesce(1).write.json(f"{root}/{version}/manifest")
    stores.switch(spark, root, version)
    return version
