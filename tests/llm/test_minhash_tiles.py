"""Buckets that stay split are compared in tiles of signatures; texts of likely partners decide."""

import random

import pytest

from framegrid.llm import minhash


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    first = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    return {i: (len(sets[i]), first[i]) for i in sets}


@pytest.mark.parametrize("tile, shingles", [(1024, 1 << 21), (8, 1 << 21), (1024, 3000)])
def test_split_buckets(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", shingles)
    r = random.Random(2)
    rows = []
    for group in range(3):
        base = [f"g{group}w{k}" for k in range(160)]
        for _ in range(45):  # near the bar on both sides, so that a bucket's leader links with some of them only
            text = list(base)
            for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9])):
                text[r.randrange(160)] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(900, ""), (901, rows[0][1]), (902, "one two")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 80)


def test_only_rows_with_a_likely_partner_get_their_text():
    sets = [minhash.shingle_set(" ".join(f"{g}{k}" for k in range(200)).encode()) for g in "aab"]
    sigs = [minhash.signature(s) for s in sets]
    sigs[2][:4] = sigs[0][:4]  # shares a band with the others, but nothing else
    key = int(minhash.band_keys(sigs[0][None, :])[0, 0])
    rows = [{"key": key, "i": 0, "j": 0, "id": i, "comp": i, "sub": 0, "sig": s.tobytes()} for i, s in enumerate(sigs)]
    assert sorted(x[3] for x in minhash._survivors(rows, 0.8)) == [0, 1]
