"""The pipeline's stages, each on its predecessor's output, against plain Python versions over all rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from framegrid.llm import classifier, packing
from framegrid.llm.common import materialise

public_tokenizers = pytest.importorskip("public_tokenizers")


def shingles(text, n=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def write_tables(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, size int, m long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def fixture_rows(spark):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 2, 3) for r in held]
    near = [(10_000 + r[0], r[1].replace(" ", "  ", 3) if k % 2 else r[1].upper(), *r[2:]) for k, r in enumerate(rows[:40]) if r[1]]
    edges = [(None, rows[5][1], "en", None, 3, 1, 2, 3), (90_001, None, None, None, None, None, None, None), (90_002, "", "en", "a", 0, 1, 2, 3), rows[7], rows[7]]
    return rows + near + edges


def plain_groups(rows):
    """The smallest id of everyone's group, by comparing all pairs."""
    sets = {}
    for r in rows:
        if r.doc_id is not None and len(s := shingles(r.text)) > len(sets.get(r.doc_id, ())):
            sets[r.doc_id] = s
    ids = sorted(sets)
    places = {}
    for i in ids:
        for g in sets[i]:
            places.setdefault(g, []).append(i)
    both = Counter((a, b) for x in places.values() for k, a in enumerate(x) for b in x[k + 1 :])
    first = {i: i for i in ids}
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(first[a], first[b])
            moved = moved or first[a] != low or first[b] != low
            first[a] = first[b] = low
    return first


def test_stages_against_plain_versions(spark, tmp_path):
    rows = fixture_rows(spark)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    write_tables(spark, str(tmp_path), rows, [(r.doc_id, r.quality, r.toxic) for r in labels])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    fns = dict(corpus_pipeline.STAGES)
    plain = lambda df: Counter(map(tuple, df.collect()))

    good = materialise(fns["quality classifier"](spark, docs, str(tmp_path)), "good")
    ratings = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = classifier.fit(docs, ratings, classifier.graded(ratings))
    sure = lambda t: 1 / (1 + np.exp(model.thresholds[-1] - classifier.raw_score(model, t.encode()))) >= 0.5 if t and t.split() else False
    assert plain(good) == Counter(r for r in map(tuple, docs.collect()) if sure(r[1])) and 0.5 * len(rows) < good.count() < len(rows)

    single = materialise(fns["minhash near-dedup"](spark, good, str(tmp_path)), "single")
    first = plain_groups(good.collect())
    want = Counter(tuple(r) for r in good.collect() if r.doc_id is None or first.get(r.doc_id, r.doc_id) == r.doc_id)
    assert plain(single) == want and sum(want.values()) < good.count() - 20

    clean = materialise(fns["pii"](spark, single, str(tmp_path)), "clean")
    assert clean.columns == single.columns and clean.count() == single.count()
    from test_pii_long import plain_spans

    before = {(r.doc_id, r.lang): r for r in single.collect()}
    for r in clean.collect():
        old = before[r.doc_id, r.lang]
        spans = plain_spans(old.text or "")
        assert (r.text == old.text) == (not spans) or "<id>" in r.text
        assert not any(old.text[a:b] in r.text for a, k, b in spans if k == 0) and r.n_chars == (len(r.text) if r.text != old.text else old.n_chars)

    mixed = materialise(fns["mixing sources"](spark, clean, str(tmp_path)), "mixed")
    got, held = plain(mixed), plain(clean)
    assert set(got) <= set(held) and all(got[r] <= 2 * n for r, n in held.items())
    size = lambda rows: sum(n * len((r[1] or "").encode().split()) for r, n in rows.items())
    assert abs(size(got) / size(held) - 1.5) < 0.25

    packed = fns["best-fit packing"](spark, mixed, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        first_ = n % 2048 or 2048
        want.update((r.doc_id, k, length) for k, length in enumerate([first_] + [2048] * ((n - first_) // 2048)))
    assert Counter((r.doc_id, r.piece, r.length) for r in packed) == want
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in used.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0, *(n for _, n in sorted(s))])[:-1].tolist() and sum(n for _, n in s) <= 2048
    assert len(used) == sum(n for _, n in packing.plan_packing(np.bincount([r.length for r in packed], minlength=2049), 2048))


def test_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
