"""Salted joins and component rounds give what plain ones give, where keys are hot and where not."""

import random

import pytest

from framegrid.llm import common
from framegrid.llm.common import materialise, spread_join
from framegrid.llm.components import connected_components


@pytest.mark.parametrize("hot", [5, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, monkeypatch, hot, how):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    r = random.Random(0)
    rows = [(r.choice([0, 0, 0, 1, 2, 3, None]), i) for i in range(300)] + [(9, 1000)]
    side = [(k, f"s{k}") for k in (0, 1, 2, 7)]
    a, b = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame(side, "k long, t string")
    got = spread_join(materialise(a, "rows"), b, ["k"], ["v"], how).select("k", "v", "t").collect()
    names = dict(side)
    want = [(k, v, names.get(k)) for k, v in rows if how == "left" or k in names]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert spread_join(materialise(a.limit(0), "rows"), b, ["k"], ["v"], how).count() == 0


@pytest.mark.parametrize("hot", [3, 10**6])
def test_components_of_stars_chains_and_rings(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    r = random.Random(1)
    links = [(500, k) for k in range(400, 460)] + [(10, k) for k in range(600, 660)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000 + k, 2000 + (k + 1) % 9) for k in range(9)]
    links += [(3000 + r.randrange(80), 3000 + r.randrange(80)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_ids_with_several_texts_take_the_greatest(spark):
    from framegrid.llm import minhash

    a, b = "x1 x2 x3 x4 x5 x6 x7 x8", "y1 y2 y3 y4 y5 y6 y7 y8 y9"
    rows = [(5, a), (5, b), (5, b), (2, a), (3, b), (None, b), (None, a), (7, None), (7, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {5: (6, 3, False), 2: (5, 2, True), 3: (6, 3, True), 7: (0, 7, True)}
    assert got[None][1:] == (None, True)
