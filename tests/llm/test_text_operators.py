"""Text operators against SQL, brute force, round trips and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrid.llm import chat, classifier, embeddings, minhash, mixing, packing, pii, quality_rules, registry, substrings, warc
from framegrid.llm.common import scratch
from framegrid.llm.components import connected_components
from framegrid.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same):
    same(registry.queries()[name], ORACLES[name])


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            double = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii_base(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in registry.op3_pii(spark, SF).collect():
        line = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r.spans.split(",")) | {""}
    for t in ("a@b@c.de x", "a@b.c-x@d.org", "1.2.3.4.5 256.1.1.1", "4111 1111 1111 1111", "+49 (30) 123-45-67", "@@", "99999999999999999999999"):
        assert pii.joined(pii.base_spans(t)) == brute_spans(t)


def test_pii_bootstraps_from_contexts(spark):
    rows = [(i, f"please write to member number u{i}@ex.org today") for i in range(20)] + [(100 + i, f"please write to member number AB-{i}7731-X today") for i in range(3)]
    rows += [(200, "an ordinary text with 123456 in it and to member only")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "id:30:40" and got[100].n_id == 1
    assert got[200].n_id == 0 and got[0].n_email == 1 and got[0].n_id == 0
    kept = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[100] == "please write to member number <id> today" and kept[200] == rows[-1][1]


def test_classifier_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    out = classifier.classify(docs, train).join(test.where("toxic = 0"), "doc_id")
    right = out.agg(F.avg(((F.col("p_ge_1") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.93
    order = out.where("p_ge_1 < p_ge_2").count()
    assert order == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    docs = documents(spark).select("doc_id", "text")
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = packing.pack(docs, TOKENIZER).collect()
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(parts) == set(want)
    for d, ps in parts.items():
        ps.sort(key=lambda r: r.piece)
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]] and sum(p.length for p in ps) == len(want[d])
        assert all(p.length == 2048 for p in ps[1:]) and all(p.length <= 2048 for p in ps)
        assert all(zlib.crc32(np.array(want[d][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in ps)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 2048
    lengths = np.bincount([r.length for r in rows], minlength=2049)
    assert len(sequences) == sum(n for _, n in packing.plan_packing(lengths, 2048)) <= 1.1 * -(-sum(r.length for r in rows) // 2048) + 1


def test_dominance_is_optimal():
    rng = np.random.default_rng(2)

    def fewest(items, cap, bins=()):
        if not items:
            return len(bins)
        w, rest, best = items[0], items[1:], 99
        for i in range(len(bins)):
            if bins[i] + w <= cap and bins[i] not in bins[:i]:
                best = min(best, fewest(rest, cap, (*bins[:i], bins[i] + w, *bins[i + 1 :])))
        return min(best, fewest(rest, cap, (*bins, w)))

    for _ in range(30):
        items = sorted(rng.integers(2, 21, 8).tolist(), reverse=True)
        counts = np.bincount(items, minlength=21)
        fixed = packing.reduce_dominated(counts, 20)
        left = [w for w in range(20, 0, -1) for _ in range(counts[w])]
        assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(items, 20)


def test_mixing_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    rated = {r.doc_id: r._fg_copies for r in mixing.mix_rates(docs).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mix_sources(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in rated.items() if v} and max(got.values()) <= 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 61), (61, 60), (70, 70)], "u long, v long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60}


def test_minhash_pruning_keeps_true_pairs():
    assert all(m <= 0.8 * 16 * (k + 1) for k, m in enumerate(minhash.least_matches(0.8)))
    a = np.arange(1000, dtype=np.uint64)
    assert minhash.similar(a, a[:800], 80) and not minhash.similar(a, a[:799], 80)


def test_embedding_chunks_lose_nothing():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 64))
    x = np.repeat(base, 5, axis=0) + rng.normal(size=(200, 64)) * rng.uniform(0.05, 0.6, (200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts, turn = embeddings.blocks_of(64), embeddings.rotation(64)
    n, m, forest, _ = embeddings.join_chunks(np.arange(200), x, np.arange(200), x, True, parts, [0.05] * 4, turn, 0.9)
    cos = x @ x.T
    np.fill_diagonal(cos, 0)
    assert (n + m == (cos >= 0.9).sum(axis=1)).all() and len(forest) < 200


@pytest.mark.parametrize("bits", [1 << 5, 1 << 16])
def test_automata_locate_every_window(spark, bits):
    """Beyond so few bits minimizers are joined, not filtered."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for r in substrings.dedup_substrings(docs, bits=bits).collect():
        w = texts[r.doc_id].split()
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r.doc_id for k in range(13)}
        assert r.n_removed == len(gone) and r.kept_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_warc_files(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "é" * 600), (2, None, "é" * 600), (3, "u", None), (None, "n", "é" * 600), (9000, "v", "x")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    manifest = warc.write_warc(pages, path, roll=100, shard=1000).collect()
    assert sum(r.records for r in manifest) == 5 and len({r.file for r in manifest}) == len(manifest) >= 3
    again = warc.write_warc(pages.repartition(3), scratch(spark, "warc"), roll=100, shard=1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, manifest))
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_bytes == 1200
    assert got[None].refers_to == 2 and bytes(got[2].payload) == ("é" * 600).encode() and bytes(got[3].payload) == b""


def test_quotes(spark):
    rows = [(1, 0, "user", "Where is the red house on the hill?"), (1, 1, "assistant", "It is near the old mill."), (1, 2, "user", "Thanks."), (1, 3, "assistant", "> > Where is the red house on the hill?\n> It is near the old mill.\n\nTo be exact, behind it."), (1, 4, "user", "> Where is the red house on the hill?\nAnd the blue one?")]
    got = {r.turn: r for r in chat.reply_threads(chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [got[k].reply_to for k in range(5)] == [None, 0, 1, 1, 0]
    assert got[3].text == "To be exact, behind it." and got[3].quote_depth == 2 and got[3].n_matched == 2
    assert got[4].level == 1 and got[4].thread == 0 and got[4].text == "And the blue one?"


EDGE = [(1, None, None), (2, "", "a"), (3, " \n ", "a"), (None, "some text here", None), (5, "w " * 3000, "b"), (5, "w " * 3000, "b"), (7, "one two three four five six", "b"), (8, "one two three four five six", None)]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in EDGE], "doc_id long, text string, source string, key int, size int")
    labels = spark.createDataFrame([(1, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    runs = {
        "rules": quality_rules.quality_rules, "classes": lambda d: classifier.classify(d, labels), "pii": pii.find_pii, "redact": pii.redact, "mix": mixing.mix_rates,
        "near": minhash.near_duplicates, "pack": lambda d: packing.pack(d, TOKENIZER), "parts": substrings.dedup_substrings, "good": lambda d: classifier.keep_good(d, labels),
    }
    for name, run in runs.items():
        n = len(run(docs).collect())
        assert n == {"near": 7, "pack": 2 * 2 + 6, "good": n}.get(name, 8), name
        assert run(docs.limit(0)).count() == 0, name
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert near[8].component_id == 7 and near[1].n_shingles == 0 and near[5].kept and near[None].kept
    assert minhash.drop_near_duplicates(docs).count() == 7
    vectors = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (None, [1.0, 0.0]), (6, [])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.cosine_links(vectors).collect()}
    assert got[5].component_id == 4 and got[4].n_links == 1 and got[3].n_links == 0 and len(got) == 7
    assert embeddings.cosine_links(vectors.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5
