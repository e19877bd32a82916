"""Hierarchical risk parity and caps against plain versions, on several walks."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tests.test_series import walk
from tidewright.operators import portfolio


def covariance(n, seed):
    r = np.array([[b / a - 1 for a, b in itertools.pairwise(walk(seed + 31 * k, 300, 0.01 * (1 + k % 4)))] for k in range(n)])
    common = np.array([b / a - 1 for a, b in itertools.pairwise(walk(seed + 7, 300, 0.03))])
    return np.cov(r + np.outer(np.linspace(0, 1.5, n), common)) * 252


def plain_hrp(cov):
    """Nested clusters merged by least single-link distance, then split in halves of their leaves in order."""
    n = len(cov)
    sd = np.sqrt(np.diag(cov))
    distance = np.sqrt(np.maximum(0, (1 - cov / np.outer(sd, sd)) / 2))
    clusters = [[i] for i in range(n)]
    while len(clusters) > 1:
        near = lambda p: min(distance[a, b] for a in clusters[p[0]] for b in clusters[p[1]])
        i, j = min(itertools.combinations(range(len(clusters)), 2), key=near)
        merged = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [merged]
    weight = np.ones(n)

    def variance(own):
        inverse = 1 / np.diag(cov)[own]
        w = inverse / inverse.sum()
        return w @ cov[np.ix_(own, own)] @ w

    def split(own):
        if len(own) < 2:
            return
        left, right = own[: len(own) // 2], own[len(own) // 2 :]
        a, b = variance(left), variance(right)
        weight[left] *= b / (a + b)
        weight[right] *= a / (a + b)
        split(left)
        split(right)

    split(clusters[0])
    return weight / weight.sum()


@pytest.mark.parametrize("n", [2, 3, 5, 8, 13])
@pytest.mark.parametrize("seed", [11, 400, 9001])
def test_hrp_equals_the_plain_version(n, seed):
    cov = covariance(n, seed)
    got = portfolio.hrp_weights(cov)
    assert got == pytest.approx(plain_hrp(cov)) and got.sum() == pytest.approx(1)


def plain_fill(w, cap):
    """The water level: weights are min(cap, scale * w) with the scale that makes them sum to one."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(cap, mid * w).sum() < 1 else (low, mid)
    return np.minimum(cap, low * w)


@pytest.mark.parametrize("seed", range(8))
def test_a_single_cap_fills_like_water(seed):
    rng = random.Random(seed)
    w = np.array([rng.random() ** 3 + 0.01 for _ in range(rng.randint(3, 20))])
    w /= w.sum()
    cap = max(0.12, 1.3 / len(w))
    got, notes = portfolio.capped(w, ["g"] * len(w), cap, None)
    assert not notes and got == pytest.approx(plain_fill(w, cap), abs=1e-6)


@pytest.mark.parametrize("seed", range(8))
def test_group_caps_keep_the_shares_within_groups(seed):
    rng = random.Random(seed)
    n = rng.randint(6, 20)
    w = np.array([rng.random() + 0.05 for _ in range(n)])
    w /= w.sum()
    of = [f"g{k % 3}" for k in range(n)]
    got, notes = portfolio.capped(w, of, None, 0.38)
    total = {g: sum(x for x, own in zip(got, of, strict=True) if own == g) for g in set(of)}
    assert not notes and max(total.values()) <= 0.38 + 1e-6 and got.sum() == pytest.approx(1)
    for g in total:
        own = [k for k in range(n) if of[k] == g]
        assert got[own] / got[own].sum() == pytest.approx(w[own] / w[own].sum())


def test_annualised_volatility_of_a_row():
    r = np.array([0.01, -0.02, 0.005])
    assert portfolio.annualised_volatility(r) == pytest.approx(r.std(ddof=1) * 252**0.5) and portfolio.annualised_volatility(r[:1]) == 0
