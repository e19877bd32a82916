"""Connected components of a distributed edge list by alternating large and small stars.

Each round joins every node to the least node around it; rounds stop when the edges do. Edges stay
in tables in the shared scratch folder; the driver sees one count and one checksum a round.

Defined cases: edges that repeat, in either direction, count once; an edge from a node to itself
makes no node; nodes may be any type that orders (structs too), not null; without edges there are no
rows. A long chain takes about as many rounds as the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import kept

MOST_ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    large: every node hangs its larger neighbours on its least one. small: every node hangs itself
    and its smaller neighbours on its least one.
    """
    around = edges
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = kept(now, "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = kept(_star(_star(now, large=True), large=False), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
