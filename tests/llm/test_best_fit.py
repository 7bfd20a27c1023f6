"""Best fit on counts against placing piece by piece."""

import numpy as np

from framegrid.llm import packing


def piece_by_piece(items, capacity):
    open_ = []
    for w in sorted(items, reverse=True):
        fits = [b for b in open_ if capacity - sum(b) >= w]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(w)
        else:
            open_.append([w])
    return open_


def test_best_fit_is_that_of_single_pieces():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        capacity = int(rng.integers(5, 60))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 60))).tolist()
        got = [x for x, n in packing.best_fit(np.bincount(items, minlength=capacity + 1), capacity) for _ in range(n)]
        want = piece_by_piece(items, capacity)
        assert sorted(map(sum, got)) == sorted(map(sum, want)) and sorted(x for g in got for x in g) == sorted(items)


def test_plan_stays_small():
    counts = np.random.default_rng(1).integers(0, 10**9, 2049)
    counts[0] = 0
    plan = packing.plan_packing(counts.copy(), 2048)
    assert len(plan) < 3 * 2048 and sum(n * sum(x) for x, n in plan) == int(np.arange(2049) @ counts)
    assert all(sum(x) <= 2048 for x, _ in plan)
