"""Spanning trees, leaf orders with ties, and hierarchical risk parity over tables against plain versions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tests.test_portfolio_plain import covariance, plain_hrp
from tidewright.operators import linkage, portfolio
from tidewright.scratch import kept


def plain_order(d):
    """The active list, merged pair by pair: the first strict minimum in row and column order; a merged node goes last."""
    n = len(d)
    clusters = [[i] for i in range(n)]
    while len(clusters) > 1:
        i, j = min(itertools.combinations(range(len(clusters)), 2), key=lambda p: min(d[a][b] for a in clusters[p[0]] for b in clusters[p[1]]))
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] + clusters[j]]
    return clusters[0] if clusters else []


def distances(rnd, n, kinds):
    d = [[0.0] * n for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        d[i][j] = d[j][i] = rnd.choice(kinds) if kinds else rnd.random()
    return d


@pytest.mark.parametrize("seed", range(60))
def test_leaf_order_with_many_ties(seed):
    rnd = random.Random(seed)
    d = np.array(distances(rnd, rnd.randrange(1, 12), [[], [1.0], [1.0, 2.0], [0.0, 0.5, 1.0, 1.5]][seed % 4]))
    assert portfolio.single_linkage_order(d) == plain_order(d)


@pytest.mark.parametrize("kinds", [[], [1.0, 2.0, 3.0]])
def test_tree_and_order_of_a_table(spark, kinds):
    rnd, n = random.Random(8), 24
    d = distances(rnd, n, kinds)
    pairs = kept(spark.createDataFrame([(i, j, d[i][j]) for i, j in itertools.combinations(range(n), 2)], "i int, j int, distance double"), "pairs")
    tree = linkage.spanning_tree(pairs, n)
    # Prim's algorithm by hand: the same total length.
    inside, total = {0}, 0.0
    while len(inside) < n:
        w, new = min((d[a][b], b) for a in inside for b in range(n) if b not in inside)
        inside.add(new)
        total += w
    assert len(tree) == n - 1 and sum(e[0] for e in tree) == pytest.approx(total)
    assert linkage.leaf_order(n, linkage.merging_edges(pairs, n)) == plain_order(d)
    with pytest.raises(ValueError, match="equal distances"):
        linkage.merging_edges(pairs, n, 5)


@pytest.mark.parametrize("n", [1, 2, 7, 13])
def test_parity_of_a_table_equals_the_plain_version(spark, n):
    cov = covariance(n, 77) if n > 1 else np.array([[0.04]])
    pairs = kept(spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(n) for j in range(i, n)], "i int, j int, cov double"), "pairs")
    want = plain_hrp(cov) if n > 1 else [1.0]
    assert portfolio.hrp_of_table(pairs, np.diag(cov)) == pytest.approx(want)


def test_paths_halve_places():
    bits, found = portfolio.paths(5)
    assert bits == 3 and found == [(0b000, 2), (0b010, 2), (0b100, 2), (0b110, 3), (0b111, 3)]


def test_parity_of_more_names_than_a_tile(spark):
    """700 names: beyond what one group used to hold."""
    rng = np.random.default_rng(4)
    days, n = 130, 700
    m = rng.normal(0, 0.01, (n, days)) * rng.uniform(0.5, 2, (n, 1)) + np.outer(rng.uniform(0, 1, n), rng.normal(0, 0.01, days))
    import pandas as pd

    rows = pd.DataFrame({"id": np.repeat(np.arange(n), days), "idx": np.tile(np.arange(days), n).astype("int32"), "ret": m.ravel()})
    held = spark.createDataFrame([(i, f"g{i % 4}") for i in range(n)], "id long, group string")
    out = portfolio.allocate(spark.createDataFrame(rows), held, "hrp").toPandas().sort_values("id")
    cov = np.cov(m) * 252
    sd = np.sqrt(np.diag(cov))
    mean = (cov / np.outer(sd, sd))[np.triu_indices(n, 1)].mean()
    shrunk = np.where(np.eye(n, dtype=bool), cov, 0.8 * cov + 0.2 * mean * np.outer(sd, sd))
    want = portfolio.hrp_weights(shrunk)
    assert len(out) == n and out["weight"].to_numpy() == pytest.approx(want, rel=1e-6)
    assert out["contribution"].sum() == pytest.approx(1)
