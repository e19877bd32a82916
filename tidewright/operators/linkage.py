"""Single linkage over a distance table: a minimum spanning tree by Boruvka's rounds, then the order of the leaves.

Each round finds every component's nearest other one by one aggregation over the table; the driver
holds one entry a leaf, and the tree has one edge fewer. The tree tells at which distances clusters merge.
Where distances are equal, which pair merges first depends on all edges of that distance, so these
are fetched too; as they tell the whole order, the merges are replayed from them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.scratch import local_table

#: Edges as long as one of the tree that the driver holds; without equal distances there are as many as the tree has.
MOST_EDGES = 5_000_000

Edge = tuple[float, int, int]


class Components:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_tree(pairs: DataFrame, n: int) -> list[Edge]:
    """The edges (distance, i, j) of a minimum spanning tree. pairs: (i, j, distance) of all i < j below n, a written table."""
    spark, parts, tree = pairs.sparkSession, Components(n), []
    while len(tree) < n - 1:
        held = local_table(spark, {"leaf": pa.array(range(n), pa.int32()), "part": pa.array([parts.of(x) for x in range(n)], pa.int32())})
        a, b = held.select(F.col("leaf").alias("i"), F.col("part").alias("a")), held.select(F.col("leaf").alias("j"), F.col("part").alias("b"))
        apart = pairs.join(a, "i").join(b, "j").where("a <> b")
        ends = apart.select(F.explode(F.array("a", "b")).alias("part"), F.struct("distance", "i", "j").alias("e"))
        # One row a component. Equal distances are told apart by the ends, so no round closes a circle.
        found = ends.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct().collect()
        if not found:
            raise ValueError("the distance table lacks pairs")
        tree += [(r["distance"], r["i"], r["j"]) for r in found if parts.join(r["i"], r["j"])]
    return tree


def merging_edges(pairs: DataFrame, n: int, most: int = MOST_EDGES) -> list[Edge]:
    """The edges that are as long as one of the spanning tree: all that the order of the merges depends on."""
    tree = spanning_tree(pairs, n)
    lengths = local_table(pairs.sparkSession, {"distance": pa.array(sorted({d for d, _, _ in tree}), pa.float64())})
    found = pairs.join(lengths, "distance").select("distance", "i", "j").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} pairs have equal distances")
    return [tuple(r) for r in found]


def leaf_order(n: int, edges: Iterable[Edge]) -> list[int]:
    """Leaves of the single-linkage tree; a merged node stands after all others.

    Merges go by distance; of equal ones the pair with the least first node, then the least second.
    Nodes are leaves 0 .. n - 1 and then merges in their order.
    """
    parts, node = Components(n), list(range(n))  # node: of a component, by its root
    children: dict[int, tuple[int, int]] = {}
    for _, same in groupby(sorted(edges), key=lambda e: e[0]):
        near: dict[int, set[int]] = {}
        root = {}
        for _, i, j in same:
            a, b = parts.of(i), parts.of(j)
            if a != b:
                near.setdefault(node[a], set()).add(node[b])
                near.setdefault(node[b], set()).add(node[a])
                root[node[a]], root[node[b]] = a, b
        due = [(x, y) for x, others in near.items() for y in others if x < y]
        heapq.heapify(due)
        while due:
            x, y = heapq.heappop(due)
            if x not in near or y not in near:  # merged meanwhile
                continue
            new = n + len(children)
            children[new] = (x, y)
            a, b = root[x], root[y]
            parts.join(a, b)
            root[new] = parts.of(a)
            node[root[new]] = new
            others = (near.pop(x) | near.pop(y)) - {x, y}
            near[new] = others
            for z in others:
                near[z] -= {x, y}
                near[z].add(new)
                heapq.heappush(due, (z, new))
    out, stack = [], [n + len(children) - 1] if n else []
    while stack:
        x = stack.pop()
        if x in children:
            stack += reversed(children[x])
        else:
            out.append(x)
    return out
