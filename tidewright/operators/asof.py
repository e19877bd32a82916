"""As-of joins by key and time: each row meets the nearest row of another table before or after it.

Both tables are cut by the same ranges of time, at approximate quantiles of both, and dealt by key and
range, so a key with a third of all rows is as many groups as there are ranges. Within a group one
window finds the match. Where a group has none before the row, the last row of an earlier range stands
in: one row a key and range is aggregated beforehand and carried over the empty ones. Ranges only
balance the groups: matches are the same whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordered import bucketed, parts_wanted
from tidewright.scratch import kept

BACKWARD, FORWARD = "backward", "forward"


def micros(time: Column) -> Column:
    """A date or timestamp as microseconds."""
    return F.unix_micros(time.cast("timestamp"))


def ranges(times: DataFrame, column: str, n: int) -> list[float]:
    """Up to n - 1 distinct cuts at approximate quantiles."""
    wanted = ", ".join(f"{i / n}D" for i in range(1, n))
    found = times.agg(F.expr(f"percentile_approx({column}, array({wanted}), {100 * n})")).first()[0] if n > 1 else None
    return sorted({float(x) for x in found or []})


def asof(left: DataFrame, right: DataFrame, time: str, by: Sequence[str] = (), direction: str = BACKWARD, tie: Sequence[str] = (), within: int | None = None, name: str = "match", parts: int | None = None) -> DataFrame:
    """``left`` with the struct ``name`` of the right row of the same key that is nearest in time; null if there is none.

    backward: the last row at or before; forward: the first at or after. Of right rows of one time the last
    (forward: the first) by the columns ``tie``. within: microseconds beyond which a match doesn't count.
    A null key equals nothing, a null time is no time. Left rows are kept, equal ones too.
    """
    if direction not in (BACKWARD, FORWARD):
        raise ValueError(f"unknown direction {direction}")
    spark, back = left.sparkSession, direction == BACKWARD
    keys = [f"_k{i}" for i in range(len(by))]
    key = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    row = F.struct(*[F.col(c) for c in right.columns])
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    a = left.select(*key, micros(F.col(time)).alias("_t"), F.struct(*left.columns).alias("_left"))
    b = right.select(*key, micros(F.col(time)).alias("_t"), F.struct(*[F.col(c) for c in tie], F.lit(0).alias("_")).alias("_tie"), row.alias("_row")).where(known)
    a, b = kept(a, "asof-left"), kept(b, "asof-right")
    cuts = ranges(a.select("_t").unionAll(b.select("_t")), "_t", parts or parts_wanted(spark))
    a, b = (bucketed(df, "_t", "_range", cuts) for df in (a, b))
    # In the order of the search the best row before is the last one: forward, that order runs back in time.
    towards = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    ends = b.groupBy(*keys, "_range").agg((F.max_by if back else F.min_by)("_row", F.struct("_t", "_tie")).alias("_last"))
    found = a.where(known).select(*keys, "_range", "_t", F.lit(1).alias("_side"), F.lit(None).cast(b.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(b.schema["_row"].dataType).alias("_row"), "_left")
    rows = b.select(*keys, "_range", "_t", F.lit(0).alias("_side"), "_tie", "_row", F.lit(None).cast(a.schema["_left"].dataType).alias("_left"))
    group = Window.partitionBy(*keys, "_range").orderBy(towards("_t"), F.col("_side"), towards("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.unionAll(found).withColumn("_near", F.last("_row", ignorenulls=True).over(group)).where("_side = 1").select(*keys, "_range", "_t", "_left", "_near")
    # One row a key and range with rows of either side: what the ranges before it end with.
    both = ends.join(found.select(*keys, "_range").distinct().withColumn("_asked", F.lit(True)), [*keys, "_range"], "full")
    over = Window.partitionBy(*keys or [F.lit(0)]).orderBy(towards("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_carried", F.last("_last", ignorenulls=True).over(over)).where("_asked").select(*keys, "_range", "_carried")
    joined = near.join(carried, [*keys, "_range"], "left").select("_t", "_left", F.coalesce("_near", "_carried").alias(name))
    if within is not None:
        apart = F.abs(F.col("_t") - micros(F.col(f"{name}.{time}")))
        joined = joined.withColumn(name, F.when(apart <= within, F.col(name)))
    lost = a.where(~known).select("_t", "_left", F.lit(None).cast(b.schema["_row"].dataType).alias(name))
    return joined.unionAll(lost).select("_left.*", name)
