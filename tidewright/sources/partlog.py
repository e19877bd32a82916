"""A table of keyed rows that is changed part by part: copy-on-write behind a log of deltas.

Rows lie in parts by the leading bits of a hash of their key. A part holds about TARGET_ROWS rows: one
that grows beyond that is split by further bits when it is rewritten, so the number of parts follows the
size of the table and no rewrite is larger than the parts that a change falls in. Beyond MOST_BITS, or
for a single large key, a part takes several files, dealt by the hash of the other columns.

The log holds one small file a commit: which parts were replaced, and the files that replace them with
their rows, bytes and least and greatest key and day. Every CHECKPOINT commits the whole list is written
too, so a reader takes the last of these and the deltas after it. A commit takes the next number, which
only one writer can have. Whoever comes second looks at what was committed meanwhile: if those commits
replaced other parts, the change is committed on top of them; else it is made anew from their rows.
Readers see the files of one version, and old files stay until ``vacuum``.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewright.scratch import kept, local_table

TARGET_ROWS = 4_000_000
#: Leading bits of the hash that parts are told by, at most.
MOST_BITS = 16
CHECKPOINT = 10
ATTEMPTS = 20


class Lost(RuntimeError):
    """Other writers came first too often."""


def place_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists; of several writers one gets True."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    fs = final.getFileSystem(conf)
    fs.mkdirs(final.getParent())
    stream = fs.create(draft, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    try:
        target = urlparse(fs.makeQualified(final).toString())
        if target.scheme == "file":  # a rename there would overwrite
            try:
                os.link(unquote(urlparse(fs.makeQualified(draft).toString()).path), unquote(target.path))
            except FileExistsError:
                return False
            return True
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        keep = spark.sparkContext._gateway.new_array(rename, 1)
        keep[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, keep)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


@dataclass(frozen=True)
class File:
    path: str
    rows: int
    bytes: int
    low: str
    high: str
    first: str | None
    last: str | None


@dataclass
class State:
    """One version: its parts, as (bits, prefix), and their files."""

    version: int = 0
    parts: dict[tuple[int, int], list[File]] = field(default_factory=dict)

    def files(self) -> list[File]:
        return [f for files in self.parts.values() for f in files]

    def apply(self, delta: dict) -> None:
        for bits, prefix in delta["gone"]:
            self.parts.pop((bits, prefix), None)
        for (bits, prefix), files in delta["new"]:
            self.parts[bits, prefix] = [File(*f) for f in files]
        self.version = delta["version"]

    def slots(self) -> tuple[int, dict[int, tuple[int, int]]]:
        """(bits, slot -> part): every value of that many leading bits and the part it falls in."""
        bits = max((b for b, _ in self.parts), default=0)
        found = {}
        for b, prefix in self.parts:
            for s in range(prefix << (bits - b), (prefix + 1) << (bits - b)):
                found[s] = (b, prefix)
        return bits, found


def loaded(names: Sequence[str], text: Callable[[str], str]) -> State:
    """The version that a log's files, sorted by name, add up to: the last checkpoint and what came after it."""
    s = State()
    whole = [n for n in names if n.endswith(".state") and not n.startswith(".")]
    if whole:
        s.apply(json.loads(text(whole[-1])))
    for n in names:
        if n.endswith(".delta") and not n.startswith(".") and int(n[:-6]) > s.version:
            s.apply(json.loads(text(n)))
    return s


def leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits else F.lit(0).cast("long")


class PartTable:
    """Rows of ``schema`` under ``root`` by the column ``key``; ``day``, if any, is a date that files are pruned by."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, key: str = "id", day: str | None = "date", target_rows: int = TARGET_ROWS, checkpoint: int = CHECKPOINT) -> None:
        self.spark, self.root, self.key, self.day = spark, root.rstrip("/"), key, day
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.target_rows, self.checkpoint = target_rows, checkpoint

    # The log.

    def _fs(self, path: str):  # noqa: ANN202 (JVM objects)
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        target, fs = self._fs(f"{self.root}/_log")
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _text(self, name: str) -> str:
        target, fs = self._fs(f"{self.root}/_log/{name}")
        stream = fs.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def deltas(self, after: int) -> list[dict]:
        """The commits after a version, in order."""
        return [json.loads(self._text(n)) for n in self._names() if n.endswith(".delta") and not n.startswith(".") and int(n[:-6]) > after]

    def state(self) -> State:
        """The current version. An empty table has version 0."""
        return loaded(self._names(), self._text)

    def exists(self) -> bool:
        return bool(self._names())

    def _delta(self, version: int, gone: Sequence[tuple[int, int]], new: dict[tuple[int, int], list[File]], dropped: Sequence[str] = ()) -> dict:
        fields = lambda f: [f.path, f.rows, f.bytes, f.low, f.high, f.first, f.last]
        return {"version": version, "gone": [list(p) for p in gone], "new": [[list(p), [fields(f) for f in files]] for p, files in new.items()], "dropped": list(dropped)}

    def _commit(self, base: State, gone: list[tuple[int, int]], new: dict[tuple[int, int], list[File]]) -> bool:
        """Whether the replacement of parts of ``base`` could be committed, on top of commits to other parts too."""
        dropped = [f.path for p in gone for f in base.parts.get(p, [])]
        for _ in range(ATTEMPTS):
            delta = self._delta(base.version + 1, gone, new, dropped)
            if place_new(self.spark, f"{self.root}/_log/{delta['version']:012}.delta", json.dumps(delta)):
                base.apply(delta)
                if base.version % self.checkpoint == 0:
                    place_new(self.spark, f"{self.root}/_log/{base.version:012}.state", json.dumps(self._delta(base.version, [], base.parts)))
                return True
            for other in self.deltas(base.version):
                if {tuple(p) for p in other["gone"]} & set(gone) or (not gone and other["gone"] == []):
                    return False
                base.apply(other)
        raise Lost(self.root)

    # Rows.

    def _paths(self, files: Sequence[File]) -> list[str]:
        return [f"{self.root}/{f.path}" for f in files]

    def rows(self, files: Sequence[File]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self._paths(files))

    def chosen(self, ids: Sequence | None = None, since: dt.date | None = None) -> list[File]:
        """The files that may hold some keys, and days from ``since`` on."""
        state = self.state()
        parts = state.parts
        if ids is not None:
            bits, slot = state.slots()
            held = local_table(self.spark, {self.key: pa.array(list(ids))}) if len(ids) else self.spark.range(0).withColumnRenamed("id", self.key)
            hit = {slot[r[0]] for r in held.select(leading(F.col(self.key).cast(self.schema[self.key].dataType), bits)).distinct().collect() if slot}
            names = [str(i) for i in ids]
            parts = {p: [f for f in files if any(f.low <= n <= f.high for n in names)] for p, files in parts.items() if p in hit}
        return [f for files in parts.values() for f in files if since is None or f.last is None or f.last >= since.isoformat()]

    def read(self, ids: Sequence | None = None, since: dt.date | None = None) -> DataFrame:
        found = self.rows(self.chosen(ids, since))
        if ids is not None:
            found = found.where(F.col(self.key).isin(*ids) if len(ids) else F.lit(False))
        return found if since is None else found.where(F.col(self.day) >= F.lit(since))

    def replace(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> State:
        """Rewrite the parts that the keys of ``changes`` fall in; ``merged(old rows of these parts, changes)`` gives their rows.

        ``merged`` may not move rows to other keys. Made anew if another writer changed the same parts.
        """
        changes = kept(changes, "changes")
        for _ in range(ATTEMPTS):
            base = self.state()
            bits, slot = base.slots()
            sizes = {r["slot"]: r["n"] for r in changes.groupBy(leading(F.col(self.key), bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a slot
            if not base.parts:
                hit, arriving = [], {(0, 0): sum(sizes.values())}
            else:
                arriving = {}
                for s, n in sizes.items():
                    arriving[slot[s]] = arriving.get(slot[s], 0) + n
                hit = sorted(arriving)
            if not arriving or (not base.parts and not sizes):
                return base
            old = self.rows([f for p in hit for f in base.parts[p]])
            most = {p: arriving[p] + sum(f.rows for f in base.parts.get(p, [])) for p in arriving}
            new = self._written(merged(old, changes), most, old.select(self.key).unionAll(changes.select(self.key)))
            if self._commit(base, hit, new):
                return base
        raise Lost(self.root)

    def _written(self, rows: DataFrame, most: dict[tuple[int, int], int], keys: DataFrame) -> dict[tuple[int, int], list[File]]:
        """Rows of some parts as new files, the parts split by further bits where they may hold too many rows. keys: of all rows that may be there."""
        new: dict[tuple[int, int], list[File]] = {}
        for (b, prefix), n in most.items():
            more = 0
            while n >> more > self.target_rows and b + more < MOST_BITS:
                more += 1
            new |= {(b + more, (prefix << more) + k): [] for k in range(1 << more)}
        bits, slot = State(parts=new).slots()
        numbers = list(new)
        at = {p: i for i, p in enumerate(numbers)}
        columns = {"_slot": pa.array(list(slot), pa.int64()), "_part": pa.array([at[p] for p in slot.values()], pa.int32())}
        placed_keys = keys.select(leading(F.col(self.key), bits).alias("_slot")).join(local_table(self.spark, columns), "_slot")
        sizes = {r["_part"]: r["n"] for r in placed_keys.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
        pieces = [max(1, -(-sizes.get(at[p], 0) // (2 * self.target_rows))) for p in slot.values()]
        table = local_table(self.spark, columns | {"_pieces": pa.array(pieces, pa.int32())})
        names = self.schema.names
        rest = [c for c in names if c != self.key]
        placed = rows.select(*names).withColumn("_slot", leading(F.col(self.key), bits)).join(table, "_slot")
        placed = placed.withColumn("_piece", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.col("_pieces"))).drop("_slot", "_pieces")
        # A large key makes several files, so its rows are dealt over several tasks.
        order = ["_part", self.key, *([self.day] if self.day else [])]
        folder = f"data/{uuid.uuid4().hex}"
        placed.repartition("_part", "_piece").sortWithinPartitions(*order).drop("_piece").write.partitionBy("_part").option("maxRecordsPerFile", 2 * self.target_rows).parquet(f"{self.root}/{folder}")
        for f, part in self._listed(folder, len(numbers)):
            new[numbers[part]].append(f)
        return new

    def _listed(self, folder: str, parts: int) -> list[tuple[File, int]]:
        """The files of a folder with what they hold, from their key and day columns."""
        base = f"{self.root}/{folder}"
        target, fs = self._fs(base)
        if not any(s.getPath().getName().startswith("_part=") for s in fs.listStatus(target)):
            return []
        found = self.spark.read.schema(StructType([*self.schema.fields, StructField("_part", IntegerType())])).option("basePath", base).parquet(base)
        day = F.col(self.day) if self.day else F.lit(None).cast("date")
        k = F.col(self.key).cast("string")
        stats = found.groupBy("_metadata.file_path", "_metadata.file_size", "_part").agg(
            F.count(F.lit(1)).alias("n"), F.min(k).alias("low"), F.max(k).alias("high"), F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last")
        )
        out = []
        for r in stats.collect():  # one row a file that was just written
            path = f"{folder}/_part={r['_part']}/{r['file_path'].rpartition('/')[2]}"
            out.append((File(path, r["n"], r["file_size"], r["low"] or "", r["high"] or "", r["first"], r["last"]), r["_part"]))
        return sorted(out, key=lambda x: x[0].path)

    def vacuum(self, versions: int = 0) -> int:
        """Delete the files that only versions before the last ``versions`` read; returns how many went. Readers of those must be done."""
        now = self.state()
        live = {f.path for f in now.files()}
        n = 0
        for delta in self.deltas(0):
            if delta["version"] <= now.version - versions:
                for path in delta["dropped"]:
                    if path not in live:
                        target, fs = self._fs(f"{self.root}/{path}")
                        n += bool(fs.delete(target, False))
        return n
