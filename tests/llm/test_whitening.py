"""Whitening against exact fractions, and its edge cases."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from conftest import SF
from framegrid.llm import registry, whitening


def plain(vectors, scale=256):
    """Sums, n V as fractions, by exact arithmetic over the different integer vectors."""
    fits = sorted({tuple(floor(Fraction(c) * scale) for c in v) for v in vectors})
    n, dim = len(fits), len(fits[0])
    s = [sum(v[k] for v in fits) for k in range(dim)]
    cov = [[sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in fits) / n for j in range(dim)] for i in range(dim)]
    return n, s, cov


def check(got, vectors, ids):
    n, s, cov = plain(vectors)
    v = np.array([[float(c) for c in row] for row in cov])
    values, vectors_ = np.linalg.eigh(v)
    values, comps = values[::-1], vectors_[:, ::-1]
    trace = float(sum(cov[k][k] for k in range(len(cov))))
    for k in range(min(4, len(cov))):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        assert set(mine) == set(ids)
        want = []
        for i, vec in zip(ids, vectors):
            x = [floor(Fraction(c) * 256) for c in vec]
            assert mine[i]["n"] == n and mine[i]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
            want.append(sum(float(Fraction(a) - Fraction(b, n)) * comps[d, k] for d, (a, b) in enumerate(zip(x, s))) / values[k] ** 0.5)
        have = [mine[i]["whitened"] for i in ids]
        sign = 1 if np.dot(want, have) >= 0 else -1
        assert np.allclose(have, np.array(want) * sign, rtol=1e-6, atol=1e-8)
        assert all(abs(r["explained"] - values[k] / trace) <= 1e-9 and r["identity_error"] <= 1e-6 for r in mine.values())


def test_query_equals_exact_fractions(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = registry.op13_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows)
    check(got, [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize("size", [1.0, 1e6, 3e12, 1e15])
def test_scatter_is_exact_for_large_and_shifted_entries(size):
    rng = np.random.default_rng(3)
    x = whitening.to_integers(rng.normal(size=(500, 5)) * size + 7 * size, 256)
    shift = [int(v) for v in x.mean(axis=0)]
    sums, cross = whitening.scatter(x, shift)
    rows = [[int(a) - b for a, b in zip(r, shift)] for r in x.tolist()]
    assert sums.tolist() == [sum(r[k] for r in rows) for k in range(5)]
    assert cross.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def test_limbs_at_the_ends_of_a_long():
    x = np.array([[np.iinfo(np.int64).min, np.iinfo(np.int64).max], [0, -1], [-(1 << 20), 1 << 20]], np.int64)
    shift = [5, -(2**62)]
    parts = whitening.limbs(x, shift)
    total = [[sum(int(p[i, j]) << (whitening.LIMB * k) for k, p in enumerate(parts)) for j in range(2)] for i in range(3)]
    assert total == [[int(v) - s for v, s in zip(row, shift)] for row in x.tolist()]
    assert whitening.to_integers(np.array([1e300, -1e300, -0.001]), 256).tolist() == [2**63 - 1, -(2**63), -1]


def test_edges(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=3).tolist() for _ in range(40)]
    good[1], good[2] = good[0], [v + 1e-9 for v in good[0]]  # one integer vector
    rows = [(k, v, "x") for k, v in enumerate(good)]
    rows += [(0, good[0], "again"), (100, None, None), (101, [1.0, None, 2.0], ""), (102, [1.0, nan, 2.0], ""), (103, [inf, 0.0, 0.0], ""), (104, [], ""), (None, good[5], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(5)
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * (40 + 2) and {r["vec_id"] for r in got} == {None, *range(40)}
    check([r for r in got if r["vec_id"] is not None], good, list(range(40)))
    assert {r["n"] for r in got} == {38}

    # other lengths have a model of their own; one vector alone has no direction
    both = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(good)] + [(50, [1.0, 2.0]), (51, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    alone = [r for r in both if r["vec_id"] in (50, 51)]
    assert len(alone) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in alone)
    assert len(both) == 4 + 3 * 40
    assert whitening.whiten(df.where("false")).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 0.0, 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4 and huge[0]["n"] == 2 and huge[0]["deviation"] is None
