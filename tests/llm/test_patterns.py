"""The pattern fit against best fit alone and the lower bound; which share of the pieces it places."""

from __future__ import annotations

import numpy as np
import pytest

from billoom.llm import packing as P

RNG = np.random.default_rng(4)
CASES = {
    "lognormal": np.minimum(RNG.lognormal(6.5, 1, 60_000).astype(int) + 1, 4096),
    "large": RNG.integers(1500, 3000, 20_000),
    "even": RNG.integers(1, 4097, 20_000),
    "alike": np.full(5000, 1365),
    "tiny": np.full(9000, 3),
    "few": np.array([4096, 4000, 96, 1, 5]),
    "none": np.array([], int),
}


@pytest.mark.parametrize("name", CASES)
def test_plan(name):
    lengths = CASES[name]
    hist = np.bincount(lengths, minlength=4097)
    classes, held = P.plan(hist), np.zeros(4097, int)
    for items, count in classes:
        assert sum(n * t for n, t in items) <= 4096
        for n, t in items:
            held[n] += t * count
    assert (held == hist).all()
    rest = hist.copy()
    rest[4096] = 0
    alone = sum(c for _, c in P._best_fit(rest, 4096, [])) + hist[4096]
    assert P.lower_bound(lengths.tolist()) <= sum(c for _, c in classes) <= alone


@pytest.mark.parametrize("name, share", [("lognormal", 0.4), ("large", 0.3), ("even", 0.4)])
def test_patterns_place_a_large_share(name, share):
    hist = np.bincount(CASES[name], minlength=4097)
    hist[4096] = 0
    kinds, repeats, step = P.fit_patterns(hist, 4096, *P.FITS[0])
    left = hist.copy()
    for items, _ in P.fill(left, 4096, kinds, repeats, step):
        assert sum(n * t for n, t in items) == 4096 and sum(t for _, t in items) <= P.FITS[0][1]
    assert 1 - left.sum() / hist.sum() >= share
    if name != "large":  # cells are shared: many of those in use stand in several of the patterns that are repeated (pairs of large ones can't)
        uses = np.bincount([c for k, r in zip(kinds, repeats, strict=True) if r >= 1 for c in set(k)])
        assert (uses[uses > 0] > 1).mean() > 0.3
