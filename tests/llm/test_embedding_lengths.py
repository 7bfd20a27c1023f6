"""Vectors of several lengths in one table, each compared with those of its own length."""

import numpy as np
import pytest

from framegrid.llm import embeddings


@pytest.mark.parametrize("chunk", [4096, 16])
def test_every_length_is_compared(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    vectors = []
    for dim, n in ((2, 30), (3, 21), (40, 40), (64, 9), (1, 1)):
        base = rng.normal(size=(n // 3 + 1, dim))
        vectors += [(base[k % len(base)] + rng.normal(size=dim) * 0.1).tolist() for k in range(n)]
    vectors += [[5.0] * 7, [5.0] * 7]
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    links = [{j for j, y in enumerate(unit) if j != i and len(x) == len(y) and x @ y >= 0.9} for i, x in enumerate(unit)]
    first = list(range(len(unit)))
    for _ in unit:
        first = [min([first[i], *(first[j] for j in links[i])]) for i in range(len(unit))]
    got = {r.vec_id: r for r in embeddings.cosine_links(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(len(unit))] == [len(x) for x in links]
    assert [got[i].component_id for i in range(len(unit))] == first
    assert got[len(unit) - 1].n_links == 1 and not got[len(unit) - 1].kept
