"""SQL over what is stored: views of a cache and of a published version, and functions.

Views are Parquet scans, so columns and filters reach the files: of a cache's files the row groups
whose dictionary lacks a wanted key are skipped. ``series_of`` is a table function of one key; as its
hash is folded before planning, only the partition that the key lies in is listed and opened.

There is no Python data source with filters pushed down here: the filters that one query pushes stay
with the relation behind a view (Spark 4.1), so a later query over the same view would miss rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewright.sources import readers, stores

FUNCTIONS = {
    "range_position(last DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "CASE WHEN high > low THEN (last - low) / (high - low) * 100 END",
    "annualised(ret DOUBLE, days DOUBLE) RETURNS DOUBLE": "CASE WHEN days > 0 AND 1 + ret > 0 THEN power(1 + ret, 252 / days) - 1 END",
}


def register(spark: SparkSession, store: stores.PriceStore | None = None, site: str | None = None, prefix: str = "") -> list[str]:
    """Views closes (of a cache), universe, series and manifest (of a published version), and the functions; returns the views' names.

    Views show the versions that are current now. With a published version there is the table function
    series_of(key) too. All names but those of the scalar functions begin with ``prefix``.
    """
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    made = {}
    if store is not None:
        made["closes"] = store.points()
    if site is not None:
        made["manifest"], made["universe"] = readers.dataset(spark, site)
        parts = readers.all_series(spark, site)
        made["series"] = parts.drop(stores.PART)
        parts.createOrReplaceTempView(f"{prefix}series_parts")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made["series"].schema)
        key = parts.schema["id"].dataType.simpleString()
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}series_of(k {key}) RETURNS TABLE({columns}) RETURN "
            f"SELECT {', '.join(made['series'].columns)} FROM {prefix}series_parts WHERE {stores.PART} = pmod(xxhash64(k), {stores.PARTS}) AND id = k"
        )
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in made]
