"""Host verdicts: hosts whose documents mostly break a rule fail, few documents are drawn to the prior."""

import random

from framegrid.llm import quality_rules as Q


def fixture(seed=3):
    r = random.Random(seed)
    words = ["river", "stone", "garden", "letter", "window", "morning", "village", "teacher", "summer", "silver"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(1000)) for _ in range(n))
    rows = []
    for k in range(4000):
        host = "h%02d" % min(int(r.expovariate(0.15)), 39) if k % 3 else "hot"
        bad = {"h03": 0.9, "h07": 0.8, "h11": 0.45, "tiny": 1.0}.get(host, 0.02)
        kind = r.choice(("symbols", "lines", "base")) if host == "h11" else "symbols" if host == "h03" else "lines"
        if r.random() < bad:
            t = {"symbols": text(60) + " #$%|" * 40, "lines": "\n".join(["same line here"] * 30 + [text(60)]), "base": text(10)}[kind]
        else:
            t = text(80)
        rows.append((k, t, host))
    rows += [(5000 + k, "#$% " * 60 + text(60), "tiny") for k in range(1)] + [(6000, None, None), (6001, text(80), None), (6001, text(80), None)]
    return rows


def test_failing_hosts_take_their_documents_along(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = Q.quality_rules(docs).collect()
    assert len(got) == len(rows)
    counts = {}
    by_host = {}
    for k, t, h in rows:
        n, chars, symbols, lines, dups, repeats = Q.text_counts((t or "").encode())
        base = n < 50 or 100 * repeats > 50 * n
        broken = (base, symbols > 0.1 * max(chars, 1), dups > 0.3 * max(lines, 1), n > 0 and not 2 * n <= chars <= 20 * n)
        counts[k] = base
        by_host.setdefault(h, []).append(broken)
    failed = set()
    for rule in range(4):
        x = {h: sum(b[rule] for b in bs) for h, bs in by_host.items()}
        n = {h: len(bs) for h, bs in by_host.items()}
        total, mean = sum(n.values()), sum(x.values()) / sum(n.values())
        between = sum(x[h] ** 2 / n[h] for h in n) - sum(x.values()) ** 2 / total - (len(n) - 1) * mean * (1 - mean)
        var = between / (total - sum(v * v for v in n.values()) / total)
        size = min(1e6, max(1e-6, mean * (1 - mean) / var - 1)) if var > 0 else 1e6
        failed |= {h for h in n if (x[h] + mean * size) / (n[h] + size) > 0.5}
    assert {"h03", "h07"} <= failed and not failed & {"hot", "h11", "h00"}
    for r in got:
        assert r.base_failed == counts[r.doc_id] and r.kept == (not r.base_failed and r.host not in failed)
    assert sum(not r.kept and not r.base_failed for r in got) > 100
