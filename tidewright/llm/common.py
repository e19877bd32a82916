"""What the operators of this subpackage share: scratch tables, free names, reading."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import scratch

#: Only ASCII white space separates words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = "\t\n\x0b\x0c\r"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Given(threading.local):
    """Scratch paths that this thread was given, in order: jobs in other threads have their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_GIVEN = _Given()


def new_path(spark: SparkSession, name: str) -> str:
    _GIVEN.paths.append(scratch.new_path(spark, name))
    return _GIVEN.paths[-1]


def written(df: DataFrame, path: str) -> None:
    """Add ``df`` to a Parquet folder; its shuffle files go when it is written, not when the driver next collects garbage."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: a lineage cut that outlives executors."""
    path = new_path(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``kept``, and then without the scratch tables given out from ``since`` on, which only made ``df``."""
    spark = df.sparkSession
    out = kept(df, name)
    for path in _GIVEN.paths[since:-1]:
        drop_path(spark, path)
    del _GIVEN.paths[since:-1]
    return out


def given() -> int:
    """How many scratch paths are out: a mark for ``settled``."""
    return len(_GIVEN.paths)


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def free_prefix(df: DataFrame, stem: str = "_tw_") -> str:
    """A column-name prefix that no column of ``df`` uses, so added columns never clash."""
    names = [c.lower() for c in df.columns]
    while any(n.startswith(stem) for n in names):
        stem = "_" + stem
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slim(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows: what Python makes of one piece stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sql_crc32(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a text's UTF-8 bytes: eight shifts a byte."""
    digit = "instr('0123456789ABCDEF', substr(hex(encode({t})), {at}, 1)) - 1"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: 16 * ({digit.format(t=text, at='2 * i::int + 1')}) + {digit.format(t=text, at='2 * i::int + 2')})"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}::bigint[]), lambda c, b: {step}), 4294967295)"
