"""Intermediate tables in the folder that all executors share.

The folder lies below ``spark.checkpoint.dir`` and is removed when the driver's JVM ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster such a folder
    would be another one on every machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _OWN:
            made = tempfile.TemporaryDirectory(prefix="tidewright-")
            atexit.register(made.cleanup)
            _OWN[context.applicationId] = f"file://{made.name}"
        root = _OWN[context.applicationId]
    return f"{root}/tidewright-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nobody else has, to be removed with the application's folder."""
    root = scratch_root(spark)
    if root not in _MARKED:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _MARKED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: a lineage cut that outlives executors.

    The files' size is known to the optimiser, so it broadcasts a small table by its own limit.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A table of values known on the driver, as literal rows of a known size."""
    return spark.createDataFrame(pa.table(columns))
