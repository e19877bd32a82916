"""State of the market from one index: distance from its high, six months, one month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import measures
from tidewright.operators.series import with_returns

LINE, RALLY = 0.9, 0.05


def classify(from_high: Column, ret_6m: Column, ret_1m: Column) -> Column:
    """Null if any input is; both lines are strict."""
    known = from_high.isNotNull() & ret_6m.isNotNull() & ret_1m.isNotNull()
    state = F.when((from_high < LINE) & (ret_1m > RALLY), "reversal-risk").when((from_high < LINE) | (ret_6m < 0), "caution").otherwise("normal")
    return F.when(known, state)


def describe(state: Column, from_high: Column) -> Column:
    below = F.concat(F.floor((1 - from_high) * 100 + 0.5).cast("string"), F.lit("%"))
    return (
        F.when(state == "reversal-risk", F.concat(F.lit("Bear rally: "), below, F.lit(" off the peak, last month sharply up")))
        .when((state == "caution") & (from_high < LINE), F.concat(F.lit("Drawn down: "), below, F.lit(" off the peak")))
        .when(state == "caution", F.lit("Weak half-year: lower than six months ago"))
        .when(state == "normal", F.lit("Calm: close to the peak, half-year not negative"))
    )


def of_panel(panel: DataFrame, anchor: int) -> DataFrame:
    """(id, from_high, ret_6m, ret_1m, state) of each index in (id, idx, close)."""
    rows = measures.anchored(with_returns(panel), [("now", anchor)])
    inputs = {"from_high": measures.distance_from_high(), "ret_6m": measures.window_return(126, 0), "ret_1m": measures.window_return(21, 0)}
    at = rows.groupBy("id").agg(*[c.alias(n) for n, c in inputs.items()])
    return at.withColumn("state", classify(F.col("from_high"), F.col("ret_6m"), F.col("ret_1m")))
