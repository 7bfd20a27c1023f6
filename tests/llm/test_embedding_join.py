"""The subspace join as it runs at every size: links and components against brute force, and how many pairs it compares."""

import numpy as np
import pytest

from framegrid.llm import embeddings as E

from test_embedding_cells import clustered


def expected(x, least=0.9):
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    first = np.arange(len(x))
    while True:
        low = np.minimum(first, np.where(links, first[None, :], len(x)).min(axis=1))
        if (low == first).all():
            return links.sum(axis=1), first
        first = low


@pytest.mark.parametrize("chunk", [8192, 300])
def test_links_of_clustered_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    x = clustered(2000, 50, 64, 0.25)
    df = spark.createDataFrame([(i, v.tolist(), 0, "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int, x string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.cosine_links(df.repartition(5)).collect())
    n, first = expected(x)
    assert got == [(i, int(n[i]), int(first[i]), bool(first[i] == i)) for i in range(len(x))]


def test_pairs_compared_on_the_tables(spark):
    """On the tables' vectors nearly all cells are reached, so nearly all pairs are compared; the README says so."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r["embedding"] is not None]
    x = np.array([r["embedding"] for r in rows if np.isfinite(r["embedding"]).all() and np.any(r["embedding"])], float)
    cells = E.Cells(64, [], np.float64, 0.9, 5)
    cells.pivots = E.choose_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), E.CELLS) @ cells.turn
    unit = E.unit_vectors(x)
    cell = (unit @ cells.turn @ cells.pivots.T).argmax(axis=1)
    radii = E.block_radii(unit @ cells.turn, cell, cells.pivots, cells.parts)
    every = np.arange(len(x))
    n, m, _, compared = E.join_chunks(every, unit, every, unit, True, cells.parts, cells.budgets, cells.turn, 0.9, (cell, cells.pivots, radii))
    assert (n + m == expected(unit)[0]).all() and 0 < compared <= len(x) ** 2
    mask = E.candidates(unit @ cells.turn, (unit @ cells.turn).astype(np.float32), cells.parts, cells.budgets)
    assert mask.mean() < 0.01  # of them few are within a block's budget
