"""Allocations: equal, inverse-volatility or hierarchical-risk-parity weights under caps.

Whatever is as large as the square of the holdings is a Spark table: covariances come from products of
tiles, the tree of the clusters from rounds over the distances (``linkage``), and the variances of all
clusters from one aggregation, as two holdings are together in the clusters that the common beginning
of their paths names. The driver holds one row a holding: weights, caps and their iterations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import groups, linkage
from tidewright.schema import ANNUAL_DAYS, MAX_HOLDINGS, MIN_ALLOCATION_DAYS
from tidewright.scratch import kept, local_table


def single_linkage_order(distance: np.ndarray) -> list[int]:
    """``linkage.leaf_order`` of a small matrix."""
    i, j = np.triu_indices(len(distance), 1)
    return linkage.leaf_order(len(distance), zip(distance[i, j].tolist(), i.tolist(), j.tolist(), strict=True))


def cluster_variance(cov: np.ndarray) -> float:
    """Variance under weights inverse to each member's own."""
    inverse = inverse_of(np.diag(cov))
    return mixed_variance(inverse.sum(), float(inverse @ cov @ inverse), float(cov.sum()), len(cov))


def inverse_of(own: np.ndarray) -> np.ndarray:
    return np.where(own > 1e-18, 1 / np.where(own > 1e-18, own, 1), 0.0)


def mixed_variance(total: float, weighed: float, plain: float, n: int) -> float:
    """From the sum of inverse variances, and of the covariances weighed by them and not; even weights where the first vanishes."""
    return max(0.0, weighed / total**2 if total > 1e-18 else plain / n**2)


def bisected(n: int, variance: Callable[[int, int], float]) -> np.ndarray:
    """Weights of n leaves in order by halving them, each half weighed against the other's variance."""
    out, due = np.ones(n), [(0, n)]
    while due:
        start, stop = due.pop()
        if stop - start > 1:
            middle = start + (stop - start) // 2
            a, b = variance(start, middle), variance(middle, stop)
            alpha = 1 - a / (a + b) if a + b > 1e-18 else 0.5
            out[start:middle] *= alpha
            out[middle:stop] *= 1 - alpha
            due += [(start, middle), (middle, stop)]
    return out


def correlation_of(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(0, np.diag(cov)))
    product = np.outer(sd, sd)
    return np.where(product > 1e-18, cov / np.where(product > 1e-18, product, 1), np.eye(len(cov)))


def parity(order: list[int], variance: Callable[[int, int], float]) -> np.ndarray:
    """Weights that sum to one, from the leaves in order and the variance of a stretch of them."""
    w = np.zeros(len(order))
    w[order] = bisected(len(order), variance)
    return w / w.sum() if w.sum() > 1e-18 else np.full(len(order), 1 / len(order))


def hrp_weights(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity of a small matrix."""
    if len(cov) < 2:
        return np.ones(len(cov))
    distance = np.sqrt(np.maximum(0, (1 - correlation_of(cov)) / 2))
    order = single_linkage_order(distance)

    def variance(start: int, stop: int) -> float:
        part = order[start:stop]
        return cluster_variance(cov[np.ix_(part, part)])

    return parity(order, variance)


def paths(n: int) -> tuple[int, list[tuple[int, int]]]:
    """(bits, (path, depth) of each place): halving n places goes left (0) or right (1) at each bit, the first bit first."""
    found, due = [(0, 0)] * n, [(0, n, 0, 0)]
    while due:
        start, stop, path, depth = due.pop()
        if stop - start == 1:
            found[start] = (path, depth)
        elif stop > start:
            middle = start + (stop - start) // 2
            due += [(start, middle, path << 1, depth + 1), (middle, stop, path << 1 | 1, depth + 1)]
    bits = max((d for _, d in found), default=0)
    return bits, [(p << (bits - d), d) for p, d in found]


def cluster_sums(pairs: DataFrame, order: list[int], own: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
    """(depth, path) of each cluster below the whole -> the sums of its covariances, weighed by the inverse variances and not.

    pairs: (i, j, cov) for i <= j of the numbers of the holdings. Twice as many rows as holdings come to the driver.
    """
    spark, inverse = pairs.sparkSession, inverse_of(own)
    bits, found = paths(len(order))
    leaf = local_table(spark, {
        "leaf": pa.array(order, pa.int32()), "path": pa.array([p for p, _ in found], pa.int64()),
        "depth": pa.array([d for _, d in found], pa.int32()), "inv": pa.array(inverse[order], pa.float64()),
    })
    side = lambda c: leaf.select(F.col("leaf").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("path", "depth", "inv")])
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    # Equal leading bits of both paths: as many levels the two are in one cluster.
    apart = F.expr("path_i ^ path_j")
    common = F.least("depth_i", "depth_j", F.lit(bits) - F.when(apart == 0, 0).otherwise(F.length(F.bin(apart))))
    both = both.withColumn("common", common).where("common > 0").withColumn("twice", F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0))
    each = both.select(F.explode(F.sequence(F.lit(1), F.col("common"))).alias("level"), "path_i", (F.col("cov") * F.col("twice")).alias("cov"), (F.col("inv_i") * F.col("inv_j")).alias("by"))
    node = F.expr(f"shiftright(path_i, {bits} - level)")
    rows = each.groupBy("level", node.alias("node")).agg(F.sum(F.col("cov") * F.col("by")).alias("weighed"), F.sum("cov").alias("plain")).collect()
    return {(r["level"], r["node"]): (r["weighed"], r["plain"]) for r in rows}


def hrp_of_table(pairs: DataFrame, own: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity from a written table (i, j, cov) for i <= j of the holdings' numbers. own: their variances."""
    n = len(own)
    if n < 2:
        return np.ones(n)
    distances = groups.correlation_distance(groups.to_correlation(pairs))
    order = linkage.leaf_order(n, linkage.merging_edges(kept(distances.where("i < j"), "distances"), n))
    sums, inverse = cluster_sums(pairs, order, own), inverse_of(own)[order]
    before = np.concatenate([[0.0], np.cumsum(inverse)])
    bits, found = paths(n)

    def variance(start: int, stop: int) -> float:
        first, last = found[start], found[stop - 1]
        # The level of a stretch that halving made: where its first and last path part, or a leaf's own.
        level = first[1] if stop - start == 1 else bits - (first[0] ^ last[0]).bit_length()
        weighed, plain = sums[level, first[0] >> (bits - level)]
        return mixed_variance(before[stop] - before[start], weighed, plain, stop - start)

    return parity(order, variance)


def waterfilled(w: np.ndarray, cap: float, passes: int = 64) -> np.ndarray:
    """Clip at the cap and spread what is clipped over the rest in proportion, until nothing is over."""
    w = w.copy()
    for _ in range(passes):
        over, free = w > cap + 1e-12, w < cap - 1e-12
        spare = (w[over] - cap).sum()
        w[over] = cap
        if spare <= 1e-12 or not free.any():
            break
        base = w[free].sum()
        w[free] += spare / free.sum() if base <= 1e-18 else spare * w[free] / base
    return w


def capped(w: np.ndarray, groups_of: list[str], per_holding: float | None, per_group: float | None, passes: int = 24) -> tuple[np.ndarray, list[str]]:
    """Weights under both caps, and a warning for each cap that can't be met (it is then left out)."""
    w, n, warnings = w.astype(float).copy(), len(w), []
    single = per_holding is not None and per_holding * n >= 1 - 1e-9
    if per_holding is not None and not single:
        warnings.append(f"a single-name cap of {per_holding:.0%} can't be met with {n} holdings")
    if single:
        w = waterfilled(w, per_holding)
    names = list(dict.fromkeys(groups_of))
    member = {g: np.array([x == g for x in groups_of]) for g in names}
    if per_group is not None and per_group * len(names) < 1 - 1e-9:
        warnings.append(f"a cap of {per_group:.0%} a group can't be met across {len(names)}")
    elif per_group is not None:
        for _ in range(passes):
            # Totals are those at the start of the pass, in the order of the groups.
            over = [(g, t) for g in names if (t := w[member[g]].sum()) > per_group + 1e-9]
            if not over:
                break
            for g, total in over:
                w[member[g]] *= per_group / total
                room = w[~member[g]].sum()
                if room <= 1e-12:
                    break
                w[~member[g]] += (total - per_group) * w[~member[g]] / room
        if single:
            w = waterfilled(w, per_holding)
    return (w / w.sum() if w.sum() > 1e-18 else np.full(n, 1 / n)), warnings


def annualised_volatility(returns: np.ndarray) -> float:
    return float(np.std(returns, ddof=1) * np.sqrt(ANNUAL_DAYS)) if len(returns) >= 2 else 0.0


def allocate(returns: DataFrame, holdings: DataFrame, scheme: str = "inverse-vol", per_holding: float | None = None, per_group: float | None = None) -> DataFrame:
    """One row a held id with its weight and risk; no row (see ``excluded``) with too few common days.

    returns: (id, idx, ret); holdings: (id, group). Ids are taken in ascending order.
    """
    if scheme not in ("equal", "inverse-vol", "hrp"):
        raise ValueError(f"unknown scheme {scheme}")
    spark, kind = returns.sparkSession, returns.schema["id"].dataType
    held = holdings.select(F.col("id").cast(kind).alias("id"), "group").limit(MAX_HOLDINGS + 1).collect()
    if len(held) > MAX_HOLDINGS:
        raise ValueError(f"more than {MAX_HOLDINGS} holdings")
    own = kept(groups.synchronised(kept(returns.join(holdings.select("id"), "id", "left_semi"), "holdings")), "synchronised")
    days = own.select("idx").distinct().count()
    cov = kept(groups.shrunk(kept(groups.covariances(own), "covariances")), "shrunk")
    if days < MIN_ALLOCATION_DAYS:
        cov = cov.limit(0)
    variances = dict(map(tuple, cov.where("i = j").select("i", "cov").collect()))  # one row a holding
    ids = sorted(variances)
    variance = np.array([variances[x] for x in ids])
    vol, n = np.sqrt(np.maximum(0, variance)), len(ids)
    if scheme == "equal" or not n:
        w = np.full(n, 1 / n if n else 0.0)
    elif scheme == "inverse-vol":
        inverse = np.where(vol > 1e-12, 1 / np.where(vol > 1e-12, vol, 1), 0.0)
        w = inverse / inverse.sum() if inverse.sum() > 1e-18 else np.full(n, 1 / n)
    else:
        names = local_table(spark, {"id": pa.array(ids), "n": pa.array(range(n), pa.int32())}).select(F.col("id").cast(kind).alias("id"), "n")
        number = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
        pairs = cov.join(number("i"), "i").join(number("j"), "j").select(F.col("i_n").alias("i"), F.col("j_n").alias("j"), "cov")
        w = hrp_of_table(kept(pairs, "pairs"), variance)
    group_of = {r["id"]: r["group"] for r in held}
    w, warnings = capped(w, [group_of[x] or "Unknown" for x in ids], per_holding, per_group) if n else (w, [])
    weights = local_table(spark, {"id": pa.array(ids) if n else pa.array([], pa.string()), "weight": pa.array(w, pa.float64())}).select(F.col("id").cast(kind).alias("id"), "weight")
    noted = F.array(*[F.lit(x) for x in warnings]).cast("array<string>")
    return groups.risk(weights, cov).select("*", F.lit(float((w * w).sum())).alias("concentration"), F.lit(days).cast("long").alias("days"), noted.alias("warnings"))


def excluded(returns: DataFrame, holdings: DataFrame) -> DataFrame:
    """(id, reason) of holdings that get no weight: no-history, or short-overlap:days."""
    have = returns.where(F.col("ret").isNotNull()).select("id").distinct()
    own = groups.synchronised(returns.join(holdings.select("id"), "id", "left_semi"))
    days = own.select("idx").distinct().count()
    absent = holdings.join(have, "id", "left_anti").select("id", F.lit("no-history").alias("reason"))
    if days >= MIN_ALLOCATION_DAYS:
        return absent
    short = holdings.join(have, "id", "left_semi").select("id", F.lit(f"short-overlap:{days}").alias("reason"))
    return absent.unionByName(short)
