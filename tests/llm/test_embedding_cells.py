"""Cells of the embedding join: what they let out is never a link, and clustered vectors are mostly not compared."""

import numpy as np
import pytest

from framegrid.llm import embeddings as E


def clustered(n, centres, dim, spread, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * rng.uniform(0, spread, (n, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def joined(x, cells=64, least=0.9):
    dim = x.shape[1]
    parts, turn = E.blocks_of(dim), E.rotation(dim)
    budgets = E.block_budgets(parts, dim, least)
    pivots = E.choose_pivots(x[::2], cells) @ turn
    cell = (x @ turn @ pivots.T).argmax(axis=1)
    radii = E.block_radii(x @ turn, cell, pivots, parts)
    every = np.arange(len(x))
    return E.join_chunks(every, x, every, x, True, parts, budgets, turn, least, (cell, pivots, radii)), E.reached(x @ turn, pivots, radii, parts, budgets), cell


@pytest.mark.parametrize("dim, centres, spread, share", [(64, 40, 0.25, 0.2), (32, 60, 0.2, 0.2), (64, 2000, 1.0, 1.0), (16, 5, 2.0, 1.0)])
def test_cells_lose_no_link_and_leave_out_most_pairs(dim, centres, spread, share):
    x = clustered(2000, centres, dim, spread)
    (n, m, forest, compared), reach, cell = joined(x)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    assert (n + m == links.sum(axis=1)).all()
    assert not (links & ~reach[:, cell]).any()
    assert len(forest) < len(x) and 0 < compared <= share * len(x) ** 2


def test_chunks_hold_all_of_their_cells():
    rng = np.random.default_rng(1)
    held = {int(k): int(rng.integers(1, 200)) for k in rng.permutation(32)[:25]}
    base, parts = E.chunk_table(held, 32, 40)
    assert all(parts[k] == -(-held.get(k, 0) // 40) for k in range(32))
    sizes = {}
    for k, n in held.items():
        for c in range(base[k], base[k] + parts[k]):
            sizes[c] = sizes.get(c, 0) + -(-n // parts[k])
    assert max(sizes.values()) <= 40 and sorted(sizes) == list(range(len(sizes)))
    reach = rng.random((20, 32)) < 0.5
    assert E.chunks_of(reach, base, parts) == [sorted({c for k in held if r[k] for c in range(base[k], base[k] + parts[k])}) for r in reach]
