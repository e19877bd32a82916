"""Group summaries, concentration, and pairwise statistics of synchronised returns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordered import finite, numbered
from tidewright.schema import ANNUAL_DAYS, SHRINKAGE
from tidewright.scratch import kept

#: Common days below which a group's average correlation is not shown.
MIN_COMMON_DAYS = 20


def summary(df: DataFrame, value: str, by: Sequence[str] = (), order: str = "id") -> DataFrame:
    """Counts by sign, mean, median, spread of the middle half (from four values on), best and worst.

    Of equal best or worst values the first by ``order`` is named.
    """
    v = finite(F.col(value))
    best = F.min_by(F.col(order), F.when(v.isNotNull(), F.struct(-v, F.col(order))))
    worst = F.min_by(F.col(order), F.when(v.isNotNull(), F.struct(v, F.col(order))))
    rows = kept(df.select(*by, value, order), "summarised")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.count(v).alias("measured"),
        F.count(F.when(v > 0, 1)).alias("positive"),
        F.count(F.when(v < 0, 1)).alias("negative"),
        F.count(F.when(v == 0, 1)).alias("flat"),
        F.avg(v).alias("mean"),
        best.alias("best"),
        worst.alias("worst"),
    )
    cuts = quantiles(rows, value, (0.25, 0.5, 0.75), by)
    joined = _joined(counts, cuts, by)
    spread = F.when(F.col("measured") >= 4, F.col("quantiles")[2] - F.col("quantiles")[0])
    return joined.select(*by, "count", "measured", "positive", "negative", "flat", "mean", F.col("quantiles")[1].alias("median"), spread.alias("spread"), "best", "worst")


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of ``left`` with those of ``right`` for the same group, a null being a group too."""
    keys = {c: f"_{c}_of" for c in by} or {"_whole": "_whole_of"}
    if not by:
        left, right = left.withColumn("_whole", F.lit(0)), right.withColumn("_whole", F.lit(0))
    right = right.withColumnsRenamed(keys)
    same = [left[a].eqNullSafe(right[b]) for a, b in keys.items()]
    return left.join(right, same, "left").drop(*keys.values(), *([] if by else ["_whole"]))


#: A group's sketch errs by one in so many places at most; the exact values are looked for that far around.
SKETCH = 10_000


def quantiles(df: DataFrame, value: str, wanted: Sequence[float], by: Sequence[str] = (), sketch: int = SKETCH) -> DataFrame:
    """(by, quantiles): for each group the exact quantiles, linear between order statistics; null without values.

    A sketch of bounded size brackets every quantile, surely so by its error bound. A second pass counts what lies
    below a bracket and each value inside, so neither a group nor its values come together: what is sorted
    is one part in some thousands of the group. ``df`` is read twice: give a written table.
    """
    v = finite(F.col(value).cast("double"))
    rows = df.select(*by, v.alias("_v"))
    groups_ = rows.select(*by, F.lit(0).alias("_whole"), "_v")
    keys = [*by, "_whole"]
    off = 4.0 / sketch  # a sketch's error, and places enough beside it in a group of over ``sketch`` values
    ends = [min(1.0, max(0.0, q + d)) for q in wanted for d in (-off, off)]
    found = groups_.groupBy(*keys).agg(F.count("_v").alias("_n"), F.expr(f"percentile_approx(_v, array({', '.join(f'{e!r}D' for e in ends)}), {sketch})").alias("_ends"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # A small group is its own bracket; so is the side on which a bracket reaches beyond all values.
    few = F.col("_n") <= sketch
    each = [
        F.struct(
            F.lit(k).alias("k"), F.lit(q).alias("q"),
            F.when(few | F.lit(q - off <= 0), F.col("_min")).otherwise(F.col("_ends")[2 * k]).alias("low"), F.when(few | F.lit(q + off >= 1), F.col("_max")).otherwise(F.col("_ends")[2 * k + 1]).alias("high"),
        )
        for k, q in enumerate(wanted)
    ]
    brackets = kept(found.select(*keys, "_n", F.explode(F.array(*each)).alias("_b")).select(*keys, "_n", "_b.*"), "brackets")
    packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct("k", "low", "high")).alias("_all"))  # as many as quantiles are wanted
    near = _joined(groups_.where(F.col("_v").isNotNull()), packed, keys)
    near = near.select(*keys, "_v", F.explode("_all").alias("_b")).where(F.col("_v") <= F.col("_b.high"))
    placed = near.groupBy(*keys, F.col("_b.k").alias("k"), F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = _joined(placed.withColumn("_upto", upto), brackets.drop("low", "high"), [*keys, "k"])
    at = (F.col("_n") - 1) * F.col("q")
    holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    ends_of = placed.groupBy(*keys, "k").agg(F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias("a"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias("b"), F.max(at - F.floor(at)).alias("part"))
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    value_at = F.coalesce(sure, F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    out = ends_of.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", value_at.alias("x")))).alias("_q"))
    every = _joined(found.select(*keys), out, keys)
    return every.select(*by, F.transform("_q", lambda s: s["x"]).alias("quantiles"))


def concentration(df: DataFrame, by: str) -> DataFrame:
    """(by, count, share, hhi): parts of the whole, largest first; hhi sums the squared shares."""
    every = Window.partitionBy()
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    shares = counts.withColumn("share", F.col("count") / F.sum("count").over(every))
    return shares.withColumn("hhi", F.sum(F.col("share") * F.col("share")).over(every)).orderBy(F.desc("count"), by)


def coverage(df: DataFrame, predicate: Column) -> DataFrame:
    """One row, ``share``: the fraction of rows that satisfy the predicate; 0 for none."""
    return df.agg(F.coalesce(F.avg(F.coalesce(predicate, F.lit(False)).cast("int")), F.lit(0.0)).alias("share"))


def subtotals(df: DataFrame, by: str, amount: str) -> DataFrame:
    """(by, amount, share, largest): sums, their part of the total, and the largest single amount."""
    sums = df.groupBy(by).agg(F.sum(amount).alias("amount"), F.max(amount).alias("largest"))
    return sums.withColumn("share", F.try_divide("amount", F.sum("amount").over(Window.partitionBy())))


def range_position(last: Column, low: Column, high: Column) -> Column:
    """Place in the range, 0 to 100; null for an empty range."""
    return F.when(high > low, (last - low) / F.when(high > low, high - low) * 100)


def synchronised(returns: DataFrame, most: int | None = None) -> DataFrame:
    """(id, idx, ret) on the days on which every id has a return. most: more ids are an error."""
    have = returns.where(F.col("ret").isNotNull()).select("id", "idx", "ret")
    ids = returns.select("id").distinct()
    n = ids.count() if most is None else ids.limit(most + 1).count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} series to pair")
    full = have.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("idx")
    return have.join(full, "idx", "left_semi")


#: Series and days of one tile of the matrix of returns.
TILE_IDS, TILE_DAYS = 256, 256


def tiles(returns: DataFrame, ids: int = TILE_IDS, days: int = TILE_DAYS) -> tuple[DataFrame, int]:
    """((block, era, ids, m), number of blocks): the matrix of synchronised returns in tiles of some series and days.

    Series are numbered in the order of their ids; ``m`` holds a tile's doubles, a row a series.
    """
    kind = returns.schema["id"].dataType.simpleString()
    names = numbered(returns.select("id").distinct(), [F.col("id")], "place")
    n = names.count()
    block = F.floor((F.col("place") - 1) / ids).cast("int")
    placed = returns.join(names, "id").select(block.alias("block"), F.floor(F.col("idx") / days).cast("int").alias("era"), "place", "id", "idx", "ret")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "idx"])
        own = pdf.drop_duplicates("place")
        m = pdf["ret"].to_numpy().reshape(len(own), -1)  # every series has the same days
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "era": [pdf["era"].iloc[0]], "ids": [own["id"].tolist()], "m": [m.tobytes()]})

    return placed.groupBy("block", "era").applyInPandas(tile, f"block int, era int, ids array<{kind}>, m binary"), -(-n // ids)


@dataclass
class Moments:
    """Counts, means and centred products of two blocks of series over the days so far; eras are merged by their means, so nothing cancels."""

    n: int = 0
    mx: np.ndarray | float = 0.0
    my: np.ndarray | float = 0.0
    xx: np.ndarray | float = 0.0
    yy: np.ndarray | float = 0.0
    xy: np.ndarray | float = 0.0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        k = x.shape[1]
        mx, my = x.mean(1), y.mean(1)
        cx, cy = x - mx[:, None], y - my[:, None]
        dx, dy, part = mx - self.mx, my - self.my, self.n * k / (self.n + k)
        self.xx = self.xx + (cx * cx).sum(1) + part * dx * dx
        self.yy = self.yy + (cy * cy).sum(1) + part * dy * dy
        self.xy = self.xy + cx @ cy.T + part * np.outer(dx, dy)
        self.mx, self.my, self.n = self.mx + dx * k / (self.n + k), self.my + dy * k / (self.n + k), self.n + k


def cross_products(returns: DataFrame, ids: int = TILE_IDS, days: int = TILE_DAYS) -> DataFrame:
    """(i, j, days, xx, yy, xy) for i <= j over synchronised returns: sums of centred squares and products.

    Each tile goes to the pairs of blocks that it is part of, so what is shuffled grows with series, days and
    blocks, not with pairs and days; a pair of blocks is multiplied era by era as matrices.
    """
    kind = returns.schema["id"].dataType.simpleString()
    made, blocks = tiles(returns, ids, days)
    made = kept(made, "tiles")
    left = made.select(F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("b"), F.lit(0).alias("side"), "era", "ids", "m")
    right = made.where("block > 0").select(F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), "era", "ids", "m")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        sums, names = Moments(), {}
        for _, era in pdf.groupby("era", sort=True):
            both = {}
            for side, who, m in zip(era["side"], era["ids"], era["m"], strict=True):
                names[side] = np.asarray(who, object)
                both[side] = np.frombuffer(m).reshape(len(who), -1)
            sums.add(both[0], both[0 if same else 1])
        x, y = names[0], names[0 if same else 1]
        i, j = np.triu_indices(len(x)) if same else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
        return pd.DataFrame({"i": x[i], "j": y[j], "days": sums.n, "xx": sums.xx[i], "yy": sums.yy[j], "xy": sums.xy[i, j]})

    return left.unionAll(right).groupBy("a", "b").applyInPandas(multiply, f"i {kind}, j {kind}, days long, xx double, yy double, xy double")


def correlations(returns: DataFrame) -> DataFrame:
    """(i, j, days, correlation) for i < j over synchronised returns; a pair without two days or without movement has correlation null."""
    own = lambda s: F.sqrt(F.col(s) / F.when(F.col("days") >= 2, F.col("days") - 1))
    raw = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    ok = (own("xx") > 1e-12) & (own("yy") > 1e-12)
    return cross_products(returns).where("i < j").select("i", "j", "days", F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).alias("correlation"))


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """(i, j, correlation) of all ordered pairs: 1 on the diagonal, 0 where it can't be told."""
    half = correlations(returns).select("i", "j", F.coalesce("correlation", F.lit(0.0)).alias("correlation"))
    ids = returns.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("correlation")).distinct()
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return ids.unionByName(half.select(both.alias("p"), "correlation").select("p.i", "p.j", "correlation"))


def average_correlation(returns: DataFrame, minimum: int = MIN_COMMON_DAYS) -> DataFrame:
    """One row, ``correlation``: the mean over the pairs; null for fewer than two ids, or too few common days."""
    pairs = correlations(returns)
    return pairs.agg(F.when(F.min("days") >= minimum, F.avg(F.coalesce("correlation", F.lit(0.0)))).alias("correlation"))


def covariances(returns: DataFrame, annual: bool = True) -> DataFrame:
    """(i, j, cov) for i <= j over synchronised returns; zero with fewer than two days."""
    scale = ANNUAL_DAYS if annual else 1
    cov = F.when(F.col("days") >= 2, F.col("xy") / F.when(F.col("days") >= 2, F.col("days") - 1) * scale).otherwise(0.0)
    return cross_products(returns).select("i", "j", cov.alias("cov"))


def shrunk(cov: DataFrame, intensity: float = SHRINKAGE) -> DataFrame:
    """Off-diagonal covariances drawn towards the mean correlation; the diagonal stays."""
    k = min(1.0, max(0.0, intensity))
    own = cov.where("i = j").select(F.col("i").alias("id"), F.sqrt(F.greatest(F.lit(0.0), F.col("cov"))).alias("sd"))
    full = cov.join(own.select(F.col("id").alias("i"), F.col("sd").alias("si")), "i").join(own.select(F.col("id").alias("j"), F.col("sd").alias("sj")), "j")
    product = F.col("si") * F.col("sj")
    apart = (F.col("i") != F.col("j")) & (product > 1e-18)
    mean = F.coalesce(F.avg(F.when(apart, F.col("cov") / F.when(product > 1e-18, product))).over(Window.partitionBy()), F.lit(0.0))
    full = full.withColumn("mean", mean)
    target = F.col("mean") * product
    return full.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise((1 - k) * F.col("cov") + k * target).alias("cov"))


def full_matrix(half: DataFrame) -> DataFrame:
    """Both triangles of (i, j, cov)."""
    return half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def to_correlation(half: DataFrame) -> DataFrame:
    """(i, j, correlation) from covariances; the identity's entry where a deviation vanishes."""
    own = half.where("i = j").select(F.col("i").alias("id"), F.sqrt(F.greatest(F.lit(0.0), F.col("cov"))).alias("sd"))
    full = half.join(own.select(F.col("id").alias("i"), F.col("sd").alias("si")), "i").join(own.select(F.col("id").alias("j"), F.col("sd").alias("sj")), "j")
    product = F.col("si") * F.col("sj")
    same = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return full.select("i", "j", F.when(product > 1e-18, F.col("cov") / F.when(product > 1e-18, product)).otherwise(same).alias("correlation"))


def correlation_distance(corr: DataFrame) -> DataFrame:
    d = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("correlation")) / 2))
    return corr.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(d).alias("distance"))


def risk(weights: DataFrame, half: DataFrame) -> DataFrame:
    """(id, weight, volatility, contribution, portfolio_volatility) from weights and covariances.

    Contributions are weight times marginal variance over the portfolio's variance, 0 without risk.
    """
    full = full_matrix(half)
    wj = weights.select(F.col("id").alias("j"), F.col("weight").alias("wj"))
    marginal = full.join(wj, "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("cov") * F.col("wj")).alias("marginal"))
    own = half.where("i = j").select(F.col("i").alias("id"), F.sqrt(F.greatest(F.lit(0.0), F.col("cov"))).alias("volatility"))
    df = weights.join(marginal, "id").join(own, "id")
    variance = F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("marginal")).over(Window.partitionBy()))
    df = df.withColumn("portfolio_volatility", F.sqrt(variance))
    p = F.col("portfolio_volatility")
    part = F.when(p > 1e-12, F.col("weight") * F.col("marginal") / F.when(p > 1e-12, p * p)).otherwise(0.0)
    return df.select("id", "weight", "volatility", part.alias("contribution"), "portfolio_volatility")


def equal_weights(half: DataFrame) -> DataFrame:
    ids = half.where("i = j").select(F.col("i").alias("id"))
    return ids.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))


def inverse_volatility_weights(half: DataFrame) -> DataFrame:
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("cov")))
    own = half.where("i = j").select(F.col("i").alias("id"), F.when(sd > 1e-12, 1 / F.when(sd > 1e-12, sd)).otherwise(0.0).alias("inverse"))
    every = Window.partitionBy()
    total = F.sum("inverse").over(every)
    even = F.lit(1.0) / F.count(F.lit(1)).over(every)
    return own.select("id", F.when(total > 1e-18, F.col("inverse") / F.when(total > 1e-18, total)).otherwise(even).alias("weight"))
