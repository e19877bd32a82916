"""Operator 4, sharding: size-tiered compaction under a versioned manifest.

A store is a folder: ``data/`` holds runs (folders of immutable Parquet files, each with a name that
nobody else has), ``manifest/`` one JSON file a version, which lists every run's files. Arrivals are
appended as runs of small shards. ``compact`` takes runs of similar size (within a factor of the mean
of their group), once FAN_IN of them have gathered, and rewrites them as one run of target-sized
files, without a shuffle; all groups that are due are merged in one job and committed together. A run
whose files have the target size is sealed and never rewritten, so a row is written about
log(target / arrival) times.

A version is committed by giving a finished file a name that must not exist yet, in one step (a hard
link on a local file system, elsewhere a rename that does not overwrite): readers see the old version
or the new one, and of two writers one gets it. The other commits the same runs over that version: rows
just written are never written again. Only a compaction whose runs another has replaced fails. What a writer that died has left is in no manifest, so
it is never data and hinders nobody. Files of replaced runs stay, so readers planned before a
compaction and reads of old versions go on working; ``expire`` removes old versions and what no
version names, after a time of grace.

The manifest has one entry a file; rows stay in the runs. Defined cases: null ids, null or empty
texts, equal rows and long texts are rows like others; columns are all carried, whatever their
names; an empty arrival adds no run; an empty store reads as no rows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.llm.common import free_prefix

#: Production sizes.
TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Runs are similar if each is within this factor of their mean.
SIMILAR = 1.5
ARRIVALS = 8


#: Groups merged in one job.
GROUPS_AT_ONCE = 64
#: Seconds after which files that no version names count as left by a writer that died.
GRACE = 24 * 3600.0


@dataclass(frozen=True)
class Run:
    name: str  # its folder below data/
    tier: int  # how many merges its oldest rows have been through
    files: tuple[tuple[str, int], ...]  # names and bytes

    @property
    def bytes(self) -> int:
        return sum(size for _, size in self.files)


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fan_in = target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("manifest", "data"):
            self._fs.mkdirs(self._path(name))

    def _path(self, name: str):  # noqa: ANN202 (a JVM object)
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # The manifest.

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json"))

    def version(self) -> int:
        return max([0, *self.versions()])

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"manifest/v{version:010}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(r["name"], r["tier"], tuple(map(tuple, r["files"]))) for r in json.loads(text)["runs"]]

    def _place(self, draft, final) -> bool:  # noqa: ANN001 (JVM paths)
        """Give the draft its final name, unless that name exists."""
        target = urlparse(final.toUri().toString())
        if target.scheme in ("", "file"):
            source = urlparse(draft.toUri().toString())
            try:
                os.link(unquote(source.path), unquote(target.path))
            except FileExistsError:
                return False
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, keep)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def commit(self, runs: list[Run], after: int) -> int:
        """Make ``runs`` version ``after`` + 1, unless someone else has."""
        version = after + 1
        draft, final = self._path(f"manifest/.draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{version:010}.json")
        stream = self._fs.create(draft, False)
        try:
            entries = [{"name": r.name, "tier": r.tier, "files": r.files} for r in runs]
            stream.write(json.dumps({"version": version, "runs": entries}).encode())
        finally:
            stream.close()
        done = self._place(draft, final)
        self._fs.delete(draft, False)
        if not done:
            raise Conflict(f"version {version} exists")
        return version

    def replaced(self, gone: set[str], new: list[Run], version: int) -> int:
        """Commit ``new`` in place of the runs named ``gone``, from ``version`` on over what others commit meanwhile.

        A Conflict where a run of ``gone`` is in the store no more.
        """
        while True:
            runs = self.runs(version)
            if not gone <= {r.name for r in runs}:
                raise Conflict(f"version {version} has replaced some of the runs")
            try:
                return self.commit([r for r in runs if r.name not in gone] + new, version)
            except Conflict:
                version = self.version()

    # Runs.

    def _run(self, name: str, tier: int) -> Run | None:
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(f"data/{name}")) if s.getPath().getName().startswith("part-")]
        return Run(name, tier, tuple(sorted(found))) if found else None

    def _written(self, rows: DataFrame, by: str) -> dict[str, str]:
        """Rows written as new folders, one for each value of the column ``by``: folder -> value."""
        base = uuid.uuid4().hex
        rows.write.partitionBy(by).option("compression", "zstd").parquet(f"{self.root}/data/{base}")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"data/{base}")) if s.isDirectory())
        return {f"{base}/{n}": n.partition("=")[2] for n in names}

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Add rows as one run, or as one run for each value of ``arrival``; returns the version."""
        by = f"{free_prefix(rows, 'tw_')}arrival"
        new = [self._run(name, 0) for name in self._written(rows.withColumn(by, arrival if arrival is not None else F.lit(0)), by)]
        return self.replaced(set(), [r for r in new if r], self.version())

    def groups(self, runs: list[Run]) -> list[list[Run]]:
        """Groups of similar, unsealed runs that are due for a merge."""
        open_runs = sorted((r for r in runs if r.bytes < len(r.files) * self.target_bytes / 2 or (len(r.files) > 1 and r.bytes < self.target_bytes)), key=lambda r: (r.bytes, r.name))
        groups: list[list[Run]] = []
        for r in open_runs:
            last = groups[-1] if groups else []
            if last and len(last) < self.fan_in and r.bytes <= SIMILAR * sum(x.bytes for x in last) / len(last):
                last.append(r)
            else:
                groups.append([r])
        return [g for g in groups if len(g) == self.fan_in]

    def _files(self, runs: list[Run]) -> list[str]:
        return [f"{self.root}/data/{r.name}/{name}" for r in runs for name, _ in r.files]

    def _rows(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self._files(runs))

    def compact(self) -> int:
        """Merge until no group is due; the groups that are due together are one job and one commit. Returns the version."""
        by = "tw_group"
        while by in self.schema.names:
            by = f"_{by}"
        while True:
            version = self.version()
            runs = self.runs(version)
            due = self.groups(runs)[:GROUPS_AT_ONCE]
            if not due:
                return version
            files = [max(1, round(sum(r.bytes for r in g) / self.target_bytes)) for g in due]
            parts = [self._rows(g).coalesce(n).withColumn(by, F.lit(k)) for k, (g, n) in enumerate(zip(due, files, strict=True))]
            written = self._written(reduce(DataFrame.unionByName, parts), by)
            merged = [self._run(name, 1 + max(r.tier for r in due[int(k)])) for name, k in written.items()]
            gone = {r.name for g in due for r in g}
            self.replaced(gone, [r for r in merged if r], version)

    def expire(self, keep: int = 1, grace: float = GRACE) -> list[str]:
        """Remove all versions but the last ``keep``, and runs that no version names and that are older than ``grace`` seconds.

        grace is longer than any writer and any reader of an old version takes. Returns the folders removed.
        """
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:010}.json"), False)
        named = {r.name for v in self.versions() for r in self.runs(v)}
        gone = []
        for base in self._fs.listStatus(self._path("data")):
            if (time.time() * 1000 - base.getModificationTime()) / 1000 < grace:
                continue
            name = base.getPath().getName()
            inner = [s.getPath().getName() for s in self._fs.listStatus(base.getPath()) if s.isDirectory() and "=" in s.getPath().getName()]
            live = [n for n in inner if f"{name}/{n}" in named]
            for n in [f"{name}/{n}" for n in inner if n not in live] if live else [name]:
                self._fs.delete(self._path(f"data/{n}"), True)
                gone.append(n)
        return gone

    def read(self, version: int | None = None, shard_col: str | None = None, tier_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """All rows; shard_col: adds run/file of each row, tier_col: its run's tier; columns: only these of the store's."""
        names = self.schema.names if columns is None else columns
        by_tier: dict[int, list[Run]] = {}
        for r in self.runs(version):
            by_tier.setdefault(r.tier, []).append(r)
        parts = []
        for tier, own in sorted(by_tier.items()):
            file = F.col("_metadata.file_path")
            shard = F.concat_ws("/", F.regexp_extract(file, r"/data/(.*)/part-\d+", 1), F.regexp_extract(file, r"/part-(\d+)", 1))
            more = [c.alias(name) for c, name in ((shard, shard_col), (F.lit(tier), tier_col)) if name]
            parts.append(self._rows(own).select(*[F.col(f"`{c}`") for c in names], *more))
        if not parts:
            empty = self.spark.createDataFrame([], self.schema).select(*[F.col(f"`{c}`") for c in names])
            more = [F.lit(None).cast(kind).alias(name) for name, kind in ((shard_col, "string"), (tier_col, "int")) if name]
            return empty.select("*", *more)
        return reduce(DataFrame.unionByName, parts)


def compacted(docs: DataFrame, root: str, key: str = "doc_id", arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardStore:
    """A store below ``root`` with ``docs`` appended as so many arrivals and compacted."""
    store = ShardStore(docs.sparkSession, root, docs.schema, target_bytes, fan_in)
    store.append(docs, F.pmod(F.xxhash64(F.col(key)), F.lit(arrivals)).cast("int"))
    store.compact()
    return store
