"""Bootstrapped identifiers over some thousand texts, and the ordinal fit, against plain versions."""

import math
import random
import re
from collections import defaultdict

import numpy as np

from framegrid.llm import classifier as C
from framegrid.llm import pii
from test_pii_long import plain_spans


def texts(n=4000, seed=5):
    r = random.Random(seed)
    fill = ["the", "meeting", "was", "late", "again", "and", "we", "left", "for", "town"]
    code = lambda: f"{r.choice('ABCD')}{r.choice('XYZ')}-{r.randrange(10**5):05d}-{r.choice('PQR')}"
    out = []
    for k in range(n):
        x = r.random()
        mail = f"user{r.randrange(10**6)}@mail{r.randrange(9)}.example.org"
        if x < 0.2:
            part = f"member number {mail if r.random() < 0.9 else code()}"
        elif x < 0.3:
            part = f"staff badge {mail if r.random() < 0.5 else code()}"  # confident only by instances others share
        elif x < 0.4:
            part = f"order code {mail if r.random() < 0.1 else code()}"
        elif x < 0.5:
            part = f"Member  Number ({code()})"
        elif x < 0.6:
            part = f"route {r.randrange(100, 999)}abc{r.randrange(99)} badge number"
        else:
            part = "member number of the day"if r.random() < 0.02 else "nothing here"
        out.append(" ".join(r.choices(fill, k=r.randint(2, 12))) + " " + part + " " + " ".join(r.choices(fill, k=r.randint(2, 12))))
    return out


def plain_bootstrap(docs, rounds=3, confident=0.8, support=3):
    occ, total = [], defaultdict(int)
    for k, t in enumerate(docs):
        spans = plain_spans(t)
        rows = [(a, b, True) for a, _, b in spans]
        for m in re.finditer(r"\S+", t):
            x = re.search(r"[A-Za-z0-9][A-Za-z0-9._/-]{4,}[A-Za-z0-9]", m.group())
            if x and len(re.findall(r"[0-9]", x.group())) >= 3 and not any(m.start() + x.start() < b and a < m.start() + x.end() for a, _, b in spans):
                rows.append((m.start() + x.start(), m.start() + x.end(), False))
        for a, b, seed in rows:
            m = re.search(r"(\S+)\s+(\S+)\s+[\"'(\[{<]*$", t[:a])
            if m:
                occ.append((k, a, b, seed, t[a:b].lower(), (m.group(1).lower(), m.group(2).lower())))
        w = t.lower().split()
        for x, y in zip(w, w[1:-1]):
            total[x, y] += 1
    edges = defaultdict(int)
    for _, _, _, seed, inst, pat in occ:
        edges[pat, inst, seed] += 1
    score = {}
    conf = {}
    seeded = {(p, i) for p, i, s in edges if s}
    for _ in range(rounds):
        sums, good = defaultdict(float), defaultdict(int)
        n = defaultdict(int)
        for p, i in {(p, i) for p, i, _ in edges}:
            c = edges.get((p, i, True), 0) + edges.get((p, i, False), 0)
            s = 1.0 if (p, i) in seeded else score.get(i, 0.0)
            sums[p] += c * s
            n[p] += c
            good[p] += s >= 0.5
        conf = {p: sums[p] / max(total[p], n[p]) for p in sums if good[p] >= support}
        doubt = defaultdict(float)
        for p, i in {(p, i) for p, i, s in edges if (p, i) not in seeded}:
            if p in conf:
                doubt[i] += math.log1p(-min(conf[p], 0.999999))
        score = {i: 1 - math.exp(d) for i, d in doubt.items()}
    sure = {p for p, c in conf.items() if c >= confident}
    found = defaultdict(set)
    for k, a, b, seed, _, p in occ:
        if not seed and p in sure:
            found[k].add((a, b))
    return found, conf


def test_bootstrap_is_that_of_the_plain_version(spark):
    docs = texts()
    found, conf = plain_bootstrap(docs)
    got = pii.find_pii(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("id:")}
        assert ids == found[r.doc_id] and r.n_id == len(ids)
    assert sum(map(len, found.values())) > 50 and any(0.1 < c < 0.8 for c in conf.values())


def test_ordinal_fit_is_at_the_optimum():
    rng = np.random.default_rng(0)
    n, k = 600, 12
    has = rng.random((n, k)) < 0.3
    forms = np.zeros((n, C.FORMS))
    forms[:, -1] = 1
    true = rng.normal(size=k)
    grades = np.digitize(has @ true + rng.logistic(size=n) * 0.7, [-0.5, 0.8])
    buckets = [np.flatnonzero(h) * 7 for h in has]
    model = C.fit_ordinal(buckets, forms, grades, 3, steps=3000)
    share = np.bincount(grades, minlength=3)
    weight = (n / share / 3)[grades] ** 0.5

    def loss(w, bias, cuts):
        s = C.WORD * has @ w + bias
        tail = 1 / (1 + np.exp(-(s[:, None] - cuts)))
        p = np.hstack((np.ones((n, 1)), tail)) - np.hstack((tail, np.zeros((n, 1))))
        return -(weight * np.log(p[np.arange(n), grades])).sum() / n + 3e-4 / 2 * ((w**2).sum() + bias**2)

    w, bias, cuts = model.weights[np.arange(k) * 7], model.weights[C.BUCKETS + C.FORMS - 1], model.thresholds
    best = loss(w, bias, cuts)
    assert cuts[0] < cuts[1] and np.corrcoef(w, true)[0, 1] > 0.97
    for step in (0.02, -0.02):
        for j in range(k):
            assert loss(w + step * (np.arange(k) == j), bias, cuts) > best - 1e-6
        for j in range(2):
            assert loss(w, bias, cuts + step * (np.arange(2) == j)) > best - 1e-6
    tails = model.tails(np.linspace(-5, 5, 50))
    assert (np.diff(tails, axis=0) > 0).all() and (tails[:, 0] > tails[:, 1]).all()


def test_repeated_ids_take_the_greatest_text(spark):
    rows = [(i, f"good words number {i} " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(60))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    twice = rows + [(i, "aaa " + t) for i, t in rows]
    a, b = (C.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(p), labels, C.graded(labels)) for x, p in ((rows, 3), (twice, 5)))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
