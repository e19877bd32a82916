"""A rolling view of every series over unbounded input: last-wins days, recent closes, a trend, all in keyed state.

A series' state is its days of late, each with the sequence number that won it, and the moments of all
its days so far. Series lie together in one of BUCKETS states by the hash of their ids, as a call to the state
store takes longer than all that is done to a series: a micro-batch reads and writes each state once. A row changes its own day only: a new day adds to the moments, a row that wins a day
over takes the old close out and puts the new one in, a row that loses changes nothing, so replayed rows
change nothing either. A day is dropped once the watermark is ``retain`` beyond it, by the next rows of its state
or by the one timer that a state has; rows so late are dropped by the watermark before. State grows with the series, not with their history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Closes that the view shows the greatest of.
RECENT = 6
#: States that the series share.
BUCKETS = 4096
ORIGIN = dt.date(2000, 1, 1)
OUT = "id {id}, days long, last_date date, last_close double, high double, slope double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trend:
    """Count, means and centred moments of (day, close); closes can be taken out again."""

    def __init__(self, n: int = 0, mt: float = 0.0, mv: float = 0.0, tt: float = 0.0, tv: float = 0.0) -> None:
        self.n, self.mt, self.mv, self.tt, self.tv = n, mt, mv, tt, tv

    def add(self, t: float, v: float) -> None:
        self.n += 1
        a = t - self.mt
        self.mt += a / self.n
        self.mv += (v - self.mv) / self.n
        self.tt += a * (t - self.mt)
        self.tv += a * (v - self.mv)

    def remove(self, t: float, v: float) -> None:
        if self.n <= 1:
            self.__init__()
            return
        b, mv = t - self.mt, self.mv
        self.mt = (self.n * self.mt - t) / (self.n - 1)
        self.mv = (self.n * mv - v) / (self.n - 1)
        self.tt -= b * (t - self.mt)
        self.tv -= (t - self.mt) * (v - mv)
        self.n -= 1

    def slope(self) -> float | None:
        return self.tv / self.tt if self.n >= 2 and self.tt > 1e-12 else None


#: A series' trend, and its days: date -> (sequence number, close).
Held = dict[Any, tuple[Trend, dict[dt.date, tuple[int, float]]]]


def packed(held: Held) -> tuple[bytes, bytes]:
    """The series of a state and their days as two Arrow tables."""
    trends = [(i, t.n, t.mt, t.mv, t.tt, t.tv) for i, (t, _) in held.items()]
    rows = [(k, d, s, c) for k, (_, days) in enumerate(held.values()) for d, (s, c) in days.items()]
    out = []
    for names, cells in ((["id", "n", "mt", "mv", "tt", "tv"], trends), (["series", "date", "seq", "close"], rows)):
        table = pa.table(dict(zip(names, map(pa.array, zip(*cells, strict=True)), strict=True)))
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            out.append(sink.getvalue().to_pybytes())
    return out[0], out[1]


def unpacked(series: bytes, days: bytes) -> Held:
    columns = lambda data: [c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns]
    held: Held = {i: (Trend(*moments), {}) for i, *moments in zip(*columns(series), strict=True)}
    own = [days for _, days in held.values()]
    for k, date, seq, close in zip(*columns(days), strict=True):
        own[k][date] = (seq, close)
    return held


class Rolling(StatefulProcessor):
    def __init__(self, retain_days: int) -> None:
        self.retain_days = retain_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "series binary, days binary, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, due = self._held()
        touched: dict[Any, None] = {}
        for part in rows:
            # Of the rows of a day in one part only the last by sequence can win.
            best = part.sort_values("seq", ascending=False, kind="stable").drop_duplicates(["id", "date"]).sort_values(["id", "date"])
            for i, date, seq, close in zip(*(best[c].tolist() for c in ("id", "date", "seq", "close")), strict=True):
                touched[i] = None
                self._take(*held.setdefault(i, (Trend(), {})), date, seq, close)
        out = []
        for i in touched:
            trend, days = held[i]
            last = sorted(days)[-RECENT:]
            out.append((i, trend.n, last[-1], days[last[-1]][1], max(days[d][1] for d in last), trend.slope()))
        self._keep(held, due, timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=["id", "days", "last_date", "last_close", "high", "slope"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(self._held()[0], None, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass

    def _held(self) -> tuple[Held, int | None]:
        """The series of this state, and the time of its timer."""
        state = self.days.get()
        return (unpacked(bytes(state[0]), bytes(state[1])), state[2]) if state else ({}, None)

    @staticmethod
    def _take(trend: Trend, days: dict[dt.date, tuple[int, float]], date: dt.date, seq: int, close: float) -> None:
        t = float((date - ORIGIN).days)
        if date in days:
            old_seq, old = days[date]
            if seq <= old_seq:
                return
            trend.remove(t, old)
        trend.add(t, close)
        days[date] = (seq, close)

    def _keep(self, held: Held, due: int | None, now: int) -> None:
        """Write the state without the days that are over by now, with a timer for the next that will be."""
        over = dt.datetime.fromtimestamp(now / 1000, dt.UTC).date() - dt.timedelta(days=self.retain_days)
        first = None
        for _, days in held.values():
            # The latest closes stay in view however old they are.
            for date in sorted(days)[:-RECENT]:
                if date > over:
                    first = date if first is None else min(first, date)
                    break
                del days[date]
        end = None
        if first is not None:
            end = int(dt.datetime.combine(first + dt.timedelta(days=self.retain_days), dt.time(), dt.UTC).timestamp() * 1000)
        if end != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if end is not None:
                self.handle.registerTimer(end)
        self.days.update((*packed(held), end))


def rolling_stream(points: DataFrame, retain_days: int = 60, late: str = "30 days") -> DataFrame:
    """Updates (id, days, last_date, last_close, high, slope) from a stream (id, date, close, seq, ts).

    One row for each series that a micro-batch touches. ts: event time, of which rows may be ``late``; ``retain_days``
    are more than that. The session needs a state store that such state can be kept in (``with_rocksdb``).
    """
    kind = points.schema["id"].dataType.simpleString()
    rows = points.where(F.col("close").isNotNull() & F.col("date").isNotNull() & F.col("id").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket"), "id", "date", "close", "seq", "ts")
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Rolling(retain_days), outputStructType=OUT.format(id=kind), outputMode="Update", timeMode="EventTime")


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each series, from written updates with their ``batch``."""
    columns = [c for c in updates.columns if c not in ("id", "batch")]
    return updates.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("u")).select("id", "u.*")


def run_to_end(spark: SparkSession, updates: DataFrame, path: str, checkpoint: str) -> None:
    """Write all updates that are there as Parquet folders, one a micro-batch; a replayed batch replaces its own."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        sink = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/run={batch}")
        updates.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
