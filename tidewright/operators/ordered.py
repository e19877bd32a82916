"""Global orders without a task that sees all rows: places, and competition ranks with ties.

Both deal the rows by ranges of the ordered value, count each part once, and add the rows of the
parts before. What goes to the driver is one or two counts a part; parts are a small multiple of the
shuffle partitions, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.scratch import kept, local_table

#: Parts a shuffle partition, so that uneven ones level out.
FINENESS = 2
#: Rows a partition that ``monotonically_increasing_id`` can number.
ROWS_BITS = 33


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def parts_wanted(spark: SparkSession) -> int:
    return FINENESS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with its rows' places 1, 2, 3 ... in an order.

    The rows are sorted within ranges and written once with the row number there; equal keys may
    only be spread over ranges by a last column of the order that tells them apart.
    """
    (at,) = free_names(df, "_at")
    dealt = df.repartitionByRange(parts_wanted(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = kept(dealt.withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(at, ROWS_BITS)
    counts = sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()))  # one row a part
    starts, total = [], 0
    for _, n in counts:
        starts.append(total)
        total += n
    part_name, start = free_names(df, "_part", "_start")
    table = local_table(df.sparkSession, {part_name: pa.array([p for p, _ in counts], pa.int64()), start: pa.array(starts, pa.int64())})
    within = F.col(at).bitwiseAND(F.lit((1 << ROWS_BITS) - 1))
    found = placed.withColumn(part_name, part).join(table, part_name)
    return found.withColumn(name, F.col(start) + within + 1).drop(at, part_name, start)


def _cuts(values: Sequence[float | None]) -> list[tuple[float, int]]:
    """(cut, how often it came) of a column's quantiles: one that came twice or more is a frequent value."""
    return [(v, len(list(same))) for v, same in groupby(x for x in values if x is not None)]


def ranked_by(df: DataFrame, values: Sequence[tuple[str, Column, bool]], salt: str = "id") -> DataFrame:
    """``df`` with a competition rank (1, 2, 2, 4) for each (name, value, descending); null without a finite value.

    Ranges are cut at approximate quantiles, so parts are about equal; a value that takes more than one
    quantile is a frequent one: its rows are dealt by a hash of ``salt`` and need no sorting, as all of
    them have the rank after the values before. So are the rows without a value. Cuts only balance the
    parts: ranks are exact whatever they are. ``df`` is read three times: give a written table. Each
    rank costs one exchange of the rows.
    """
    spark = df.sparkSession
    n = parts_wanted(spark)
    keys = free_names(df, *[f"_v{i}" for i in range(len(values))])
    # Ascending order of the key is the order of the ranks; adding zero makes one of both zeros.
    signed = [(-finite(v.cast("double")) if down else finite(v.cast("double"))) + F.lit(0.0) for _, v, down in values]
    keyed = df.select("*", *[v.alias(k) for k, v in zip(keys, signed, strict=True)])
    wanted = "array(" + ", ".join(f"{i / n}D" for i in range(1, n)) + ")"
    row = keyed.agg(*[F.expr(f"percentile_approx({k}, {wanted}, {100 * n})").alias(k) for k in keys]).first() if n > 1 else None
    cuts = [_cuts((row[k] if row else None) or []) for k in keys]
    buckets, ties = free_names(df, *[f"_b{i}" for i in range(len(keys))]), free_names(df, *[f"_t{i}" for i in range(len(keys))])
    placed = keyed
    for k, b, t, own in zip(keys, buckets, ties, cuts, strict=True):
        placed = bucketed(placed, k, b, [c for c, _ in own])
        often = local_table(spark, {b: pa.array(range(len(own) + 1), pa.int32()), t: pa.array([0] + [m if m > 1 else 0 for _, m in own], pa.int32())})
        low = local_table(spark, {b: pa.array(range(len(own) + 1), pa.int32()), f"{b}_low": pa.array([None] + [c for c, _ in own], pa.float64())})
        placed = placed.join(often.join(low, b), b, "left")
        placed = placed.withColumn(t, F.when((F.col(t) > 0) & (F.col(k) == F.col(f"{b}_low")), F.col(t)).otherwise(0)).drop(f"{b}_low")
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(b).alias("b"), (F.col(t) > 0).alias("t"), F.col(k).isNotNull().alias("v")) for i, (k, b, t) in enumerate(zip(keys, buckets, ties, strict=True))]))
    counts = placed.select(which.alias("w")).where("w.v").groupBy("w.i", "w.b", "w.t").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows a part
    out = placed
    for i, ((name, _, _), k, b, t, own) in enumerate(zip(values, keys, buckets, ties, cuts, strict=True)):
        sizes = {(r["b"], r["t"]): r["n"] for r in counts if r["i"] == i}
        starts, total = [], 0
        for bucket in range(len(own) + 1):
            for tie in (True, False):  # the frequent value is the lowest of its range
                starts.append((bucket, tie, total))
                total += sizes.get((bucket, tie), 0)
        sub, start, is_tie = free_names(out, "_sub", "_start", "_tie")
        columns = {b: pa.array([s[0] for s in starts], pa.int32()), is_tie: pa.array([s[1] for s in starts]), start: pa.array([s[2] for s in starts], pa.int64())}
        spread = F.when(F.col(k).isNull(), F.pmod(F.xxhash64(salt), F.lit(n))).when(F.col(t) > 0, F.pmod(F.xxhash64(salt), F.col(t))).otherwise(-1)
        w = Window.partitionBy(b, is_tie, sub).orderBy(k)
        out = out.select("*", spread.cast("int").alias(sub), (F.col(t) > 0).alias(is_tie)).join(local_table(spark, columns), [b, is_tie], "left")
        rank = F.when(F.col(k).isNotNull(), F.col(start) + F.rank().over(w)).alias(name)
        out = out.select(*[c for c in out.columns if c != name], rank).drop(sub, start, is_tie)
    return out.select(*[c for c in df.columns if c not in {v[0] for v in values}], *[v[0] for v in values])


def bucketed(df: DataFrame, key: str, name: str, cuts: list[float]) -> DataFrame:
    """``df`` with the range of ``key``: how many of the ascending cuts are at or below it."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    (raw,) = free_names(df, "_raw")
    splits = [float("-inf"), *cuts, float("inf")]
    filled = df.withColumn(raw, F.coalesce(key, F.lit(0.0)))
    found = Bucketizer(splits=splits, inputCol=raw, outputCol=name, handleInvalid="error").transform(filled)
    return found.withColumn(name, F.col(name).cast("int")).drop(raw)
