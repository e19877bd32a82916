"""Versioned stores: a version is a folder, and one pointer file names the current version.

A writer fills a new folder and then replaces the pointer in one step, so readers see the old
version or the new one. Published rows are partitioned by a hash of their id into PARTS folders; cached
closes lie in parts that change one by one.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidewright.operators import merge
from tidewright.scratch import kept, local_table
from tidewright.sources import partlog

PART, PARTS = "id_part", 64
LOG = logging.getLogger(__name__)


def part_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def parts_of(spark: SparkSession, ids: Sequence, kind: DataType) -> list[int]:
    """The partitions of some ids."""
    if not len(ids):
        return [-1]
    rows = local_table(spark, {"id": pa.array(list(ids))}).select(part_of(F.col("id").cast(kind))).distinct()
    return [r[0] for r in rows.collect()]


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 (JVM objects)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it can't be read."""
    target, fs = _fs(spark, path)
    try:
        stream = fs.open(target)
        try:
            return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    except Py4JJavaError:
        return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    target, fs = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, overwrite)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current version, or None if there is none."""
    name = read_text(spark, f"{root}/CURRENT")
    return f"{root}/{name.strip()}" if name and name.strip() else None


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def switch(spark: SparkSession, root: str, version: str) -> None:
    write_text(spark, f"{root}/CURRENT", version)


def write_parts(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Rows in folders by the hash of their id, sorted within."""
    placed = df.withColumn(PART, part_of(F.col("id")))
    # Ranges of (part, id): as many tasks as the session shuffles to, each with few parts' files.
    placed.repartitionByRange(PART, "id").sortWithinPartitions(PART, *order).write.partitionBy(PART).parquet(path)


@dataclass(frozen=True)
class PriceStore:
    """Cached closes (id, date, close); ``read`` is None where nothing readable is there.

    The pointer names a table of parts (``partlog``): ``write`` makes a new one, ``merge`` and ``forget`` rewrite
    only the parts that their ids fall in.
    """

    spark: SparkSession
    root: str
    schema: str = "id string, date date, close double"
    target_rows: int = partlog.TARGET_ROWS

    def table(self) -> partlog.PartTable | None:
        """The current table of parts, or None if there is none."""
        at = current(self.spark, self.root)
        found = partlog.PartTable(self.spark, at, self.schema, target_rows=self.target_rows) if at else None
        return found if found and found.exists() else None

    def read(self, ids: Sequence | None = None, since: dt.date | None = None) -> DataFrame | None:
        """All closes, or those of some ids, or from a day on: only files that may hold them are opened."""
        table = self.table()
        return None if table is None else table.read(ids, since)

    def points(self) -> DataFrame:
        """What is cached, or no rows."""
        found = self.read()
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def ids(self) -> DataFrame:
        return self.points().select("id").distinct()

    def write(self, points: DataFrame) -> None:
        """A new version with these rows; the old one stays until the switch."""
        version = new_version()
        partlog.PartTable(self.spark, f"{self.root}/{version}", self.schema, target_rows=self.target_rows).replace(points.select("id", "date", "close"), lambda old, new: new)
        switch(self.spark, self.root, version)

    def merge(self, fetched: DataFrame, retain_from: dt.date, seq: str | None = None) -> None:
        """Fetched closes over the cached ones of the same ids (``merge.last_wins``); closes before ``retain_from`` go from the parts that are rewritten."""
        table = self.table()
        if table is None:
            self.write(merge.last_wins(self.points(), fetched, retain_from, seq))
        else:
            table.replace(fetched, lambda old, new: merge.last_wins(old, new, retain_from, seq))

    def forget(self, ids: DataFrame) -> None:
        """Drop the ids of a table, e.g. those that left the universe."""
        table = self.table()
        if table is not None:
            table.replace(ids.select(F.col("id").cast(table.schema["id"].dataType).alias("id")).distinct(), lambda old, gone: old.join(gone, "id", "left_anti"))


@dataclass(frozen=True)
class EarningsStore:
    """Announcements that never change once stored, and the day up to which they were fetched."""

    spark: SparkSession
    root: str
    schema: str = "id string, date date, eps_actual double, eps_estimated double, revenue_actual double, revenue_estimated double"

    def read(self) -> tuple[dt.date, DataFrame] | None:
        """(fetched to, rows), or None where nothing of the right shape is there."""
        at = current(self.spark, self.root)
        text = read_text(self.spark, f"{at}/state.json") if at else None
        try:
            to = dt.date.fromisoformat(json.loads(text or "")["fetched_to"])
            return to, self.spark.read.schema(f"{self.schema}, {PART} int").parquet(f"{at}/rows").drop(PART)
        except (ValueError, KeyError, TypeError, AnalysisException):
            return None

    def write(self, fetched_to: dt.date, rows: DataFrame) -> None:
        version = new_version()
        write_parts(rows, f"{self.root}/{version}/rows", ["id", "date"])
        write_text(self.spark, f"{self.root}/{version}/state.json", json.dumps({"fetched_to": fetched_to.isoformat()}))
        switch(self.spark, self.root, version)

    def refresh(self, today: dt.date, answers, seq: str = "seq") -> tuple[dt.date, DataFrame]:  # noqa: ANN001
        """The store brought up to ``today``.

        answers(start, end) gives the rows of all symbols between two days, with a column ``seq``; it is
        asked for the tiles of the days that are missing. If it fails for one, the store stays as it was.
        """
        old = self.read()
        retain, start = merge.earnings_bounds(old[0] if old else None, today)
        nothing = self.spark.createDataFrame([], self.schema)
        fresh = nothing.withColumn(seq, F.lit(None).cast("long"))
        try:
            for tile in merge.tiles(self.spark, start, today).collect() if start <= today else []:  # some two dozen at most
                fresh = fresh.unionByName(answers(tile["start"], tile["end"]).select(*fresh.columns))
            fresh = kept(fresh, "announcements")
        except Exception as e:  # noqa: BLE001 (whatever a provider raises costs freshness only)
            LOG.warning("announcements stay as they were: %s", e)
            return old or (retain - dt.timedelta(days=1), nothing)
        self.write(today, merge.first_wins(old[1] if old else nothing, fresh, retain, seq=seq))
        return self.read()
