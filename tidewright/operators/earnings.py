"""The latest announcement that is public at the anchor."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.series import next_days
from tidewright.schema import EARNINGS_MAX_AGE

FIELDS = ("date", "eps_actual", "eps_estimated")


def placed(events: DataFrame, dates: Sequence[dt.date]) -> DataFrame:
    """(id, date, eps_actual, eps_estimated, mark): the newest event of each id up to the last day of ``dates``.

    mark is the index of the first trading day on or after it. The newest event decides: one that is
    too old leaves its id without a row.
    """
    if not dates:
        return events.select("id", *FIELDS, F.lit(0).alias("mark")).limit(0)
    newest = events.where(F.col("date") <= F.lit(dates[-1])).groupBy("id").agg(F.max(F.struct(*FIELDS)).alias("e")).select("id", "e.*")
    near = newest.withColumn("day", F.greatest("date", F.lit(dates[0])))
    found = near.join(next_days(events.sparkSession, dates), "day").select("id", *FIELDS, F.col("idx").alias("mark"))
    return found.where(len(dates) - 1 - F.col("mark") <= EARNINGS_MAX_AGE)


def surprise() -> Column:
    """Actual less estimate, per the close as of the announcement's day."""
    return (F.col("eps_actual") - F.col("eps_estimated")) / F.col("mark_close")


def since_return(anchor: int) -> Column:
    """Return from the announcement's day to the anchor; null unless both as-of points differ."""
    return F.when((F.col("mark") < anchor) & (F.col("end_idx") > F.col("mark_idx")), F.col("end_close") / F.col("mark_close") - 1)


def latest(events: DataFrame, rows: DataFrame, dates: Sequence[dt.date]) -> DataFrame:
    """(id, date, eps_actual, eps_estimated, surprise, since_return): one row an id at most. rows: the panel with ``end``."""
    anchor = len(dates) - 1
    at = lambda i, field: F.max(F.when(F.col("idx") == i, F.col(f"end.{field}")))
    points = [at(i, f).alias(f"{name}_{f}") for name, i in (("end", F.lit(anchor)), ("mark", F.col("mark"))) for f in ("idx", "close")]
    own = placed(events, dates).join(rows.select("id", "idx", "end"), "id").groupBy("id", *FIELDS, "mark").agg(*points)
    return own.select("id", *FIELDS, surprise().alias("surprise"), since_return(anchor).alias("since_return"))
