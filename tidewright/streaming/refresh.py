"""The merges over unbounded input: first-wins by watermark state, last-wins by micro-batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewright.operators import merge
from tidewright.sources.stores import PriceStore


def first_wins_stream(events: DataFrame, keys: tuple[str, ...] = ("id", "date"), time: str = "ts", late: str = "220 days") -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def last_wins_stream(points: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], retain_from: dt.date, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (id, date, close) merged over what ``read`` gives, for ``write`` to swap in.

    A batch that is replayed after a failure merges to the same table.
    """

    def swap(batch: DataFrame, _: int) -> None:
        write(merge.last_wins(read(), batch, retain_from))

    return points.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_stream(points: DataFrame, store: PriceStore, retain_from: dt.date, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (id, date, close) merged into a cache: only the parts of its ids are rewritten, and a replay changes nothing."""

    def merged(batch: DataFrame, _: int) -> None:
        store.merge(batch, retain_from)

    return points.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
