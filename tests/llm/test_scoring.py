"""Scores against a plain trie with explicit sets of excluded bytes, and edge cases."""

from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import pytest

from framegrid.llm import registry, scoring
from conftest import SF


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in lower(text).encode().split()] + [None]


def plain(rows, order=scoring.ORDER):
    """(id, held out, tokens, known, N, base, score) of (id, text), all models in dictionaries."""
    out_of = lambda i: i is None or crc32(str(i).encode()) % 10 == 0
    count, nodes = Counter(), defaultdict(Counter)
    for i, text in rows:
        if not out_of(i):
            count.update(words(text or ""))
            data = (256,) * order + tuple((text or "").encode()) + (256,)
            for at in range(order, len(data)):
                for k in range(order + 1):
                    nodes[data[at - k : at]][data[at]] += 1
    n, v = sum(count.values()), len(count)
    got = []
    for i, text in rows:
        own = words(text or "")
        base = sum(log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        data = (256,) * order + tuple((text or "").encode()) + (256,)
        total = 0.0
        for at in range(order, len(data)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                rest = {s: c for s, c in nodes.get(data[at - k : at], {}).items() if s not in excluded}
                if not rest:
                    continue
                whole = sum(rest.values()) + len(rest)
                if data[at] in rest:
                    p *= rest[data[at]] / whole
                    break
                p *= len(rest) / whole
                excluded |= set(rest)
            else:
                p /= 257 - len(excluded)
            total += log10(p)
        got.append((i, out_of(i), len(own), sum(count[w] > 0 for w in own), n, base, total))
    return got


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def test_equals_plain_trie(spark):
    rows = [(r["doc_id"], (r["text"] or "")[:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(scoring.score(df).collect(), plain(rows))


@pytest.mark.parametrize("order", [3, 5])
def test_other_orders_chunks_and_long_texts(spark, monkeypatch, order):
    rows = [(k, "The cat sat on the mat %d " % (k % 7) * (1 + k % 4)) for k in range(40)] + [(99, "Ünïcode ▁ \x00 ends")]
    monkeypatch.setattr(scoring, "SLICE", 64)  # parts of texts; in the driver's process, where the plain functions are called
    texts = [t.encode() for _, t in rows]
    cut = [c for parts in scoring.parts_of(texts, order) for c in [scoring.codes_of(parts, order)]]
    monkeypatch.undo()
    whole = scoring.codes_of(next(scoring.parts_of(texts, order)), order)
    assert [x for c, _ in cut for x in c.tolist()] == whole[0].tolist() and sum(n.sum() for _, n in cut) == whole[1].sum()
    same(scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), order=order).collect(), plain(rows, order))


def test_shards_cut_between_buffers(spark, monkeypatch):
    """A buffer of a few rows gives the same lengths as one of all rows."""
    rows = [(k, f"alpha beta {k} gamma" * 3) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = scoring.chunk_texts(df, "doc_id", "text", None, 10)
    from pyspark.sql import functions as F

    grams = scoring.materialise(scoring.counted(held, 4).where("key is not null").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    one = {r["key"]: r["value"] for r in scoring.code_lengths(grams, 4).collect()}
    keys = sorted((r["key"], r["n"]) for r in grams.collect())
    assert set(one) == {k for k, _ in keys}
    source = scoring.code_lengths.__globals__
    monkeypatch.setitem(source, "BUFFER", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {r["key"]: r["value"] for r in scoring.code_lengths(grams, 4).collect()} == pytest.approx(one)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a B"), (4, "x" * 300_000), (5, " \t\n"), (10, "zzz qqq")]
    df = spark.createDataFrame([(i, t, -1.0, 0) for i, t in rows], "doc_id long, text string, score double, chunk int")
    got = scoring.score(df).collect()
    same([r for r in got if r["doc_id"] != 4], [r for r in plain(rows) if r[0] != 4])
    assert scoring.score(df.where("false")).collect() == []
    none = scoring.score(df.withColumn("use", df.score > 0), train="use").collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)
    assert {r["doc_id"]: r["score"] for r in none}[2] == pytest.approx(-log10(257))


def test_adaptive_mode_learns_on_the_way(spark):
    df = spark.createDataFrame([(1, "abracadabra " * 40), (2, "".join(chr(33 + k * 37 % 90) for k in range(480))), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.adaptive_scores(df).collect()}
    assert got[1]["n_bytes"] == 480 and got[1]["score"] > got[2]["score"] and got[3]["score"] == pytest.approx(-log10(257))
    assert scoring.adaptive_log10(b"aa", 2) == pytest.approx(-log10(257 * 2 * 2 * 256))


def test_held_out_texts_are_far_better_than_chance(spark):
    got = [r for r in registry.op12_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    size = {r["doc_id"]: r["n"] for r in spark.sql("select doc_id, octet_length(text) as n from parquet.`/root/testdata/sf0.01/documents.parquet`").collect()}
    assert len(got) > 50 and sum(r["score"] for r in got) > -0.3 * log10(257) * sum(size[r["doc_id"]] for r in got)
