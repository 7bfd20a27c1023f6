"""Alignment against a plain merge of token ends, and edge cases."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from conftest import SF
from framegrid.llm import alignment, registry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The query's rows by whole-text encoding and dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    back = {c: b for b, c in ((bytes([b]), c) for c, b in alignment.byte_alphabet().items())}
    assert left.decode(left.encode(" ünïcode").ids) == " ünïcode" and isinstance(left.decoder, decoders.ByteLevel)

    def piece(k):
        name = right.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if right.is_byte(k) else name.replace("▁", " ").encode()

    held, count = [], Counter()
    for i, text in rows:
        whole = " " + (text or "")
        x = left.encode(whole, add_special_tokens=False).ids if text else []
        y = right.encode(text) if text else []
        bytes_a = [b"".join(back[c] for c in left.id_to_token(k)) for k in x]
        bytes_b = [piece(k) for k in y]
        if b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
            held.append((i, [], [], []))
            continue
        groups, p, q, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
        while p < len(x) or q < len(y):
            if ea <= eb and p < len(x):
                ga.append(x[p])
                ea += len(bytes_a[p])
                p += 1
            else:
                gb.append(y[q])
                eb += len(bytes_b[q])
                q += 1
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        held.append((i, x, y, groups))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, x, y, groups in held:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), digest))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def test_query_equals_plain_merge(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert order(registry.op11_alignment(spark, SF).collect()) == order(plain(rows))


def test_edges(spark):
    texts = ["plain words and more", "", None, "  two  blanks  ", " ", "a", "tab\tand\nline\r\n", "<|endoftext|> is text, so are <s> and <0x0A>", "naïve façade — “quotes” 漢字 🙂", "literal ▁ sign", "plain words and more", "x" * 60_000, "ab " * 30_000, "é combining", " nbsp  em", "nul \x00 byte", " lead"]
    rows = [(None if k == 5 else k % 12, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, links string").repartition(4)
    got = alignment.align(df, A, B, with_groups=True)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(got.select(names).collect()) == order(plain(rows))
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got.collect())
    assert alignment.align(df.where("false"), A, B).collect() == []


def test_units_are_encoded_as_in_whole_texts(spark):
    side = alignment.PieceSide(B)
    assert side.by_unit
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").select("text").limit(400).collect()]
    whole = side.model.encode(texts, num_threads=1)
    for _ in range(2):  # units are kept from their second time on
        assert [x.tolist() for x in side.ids(texts)] == whole


def test_small_chunks_give_the_same(spark, monkeypatch):
    rows = [(k, f"some words come again {k % 5} and again") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = order(plain(rows))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(alignment.align(df, A, B).select(names).collect()) == want
    assert sum(r["n"] for r in alignment.pair_counts(alignment.chunk_pairs(alignment.materialise(alignment.aligned(df, A, B), "x"), "uint32"), 32000).collect()) == sum(r[4] for r in want)


@pytest.mark.parametrize("a, b, want", [([1, 3, 4], [2, 3, 4], [(1, 1), (2, 2)]), ([], [1], []), ([5], [1, 2, 5], [(0, 2)]), ([2, 4], [1, 3], [])])
def test_merge_ends(a, b, want):
    import numpy as np

    assert list(zip(*(x.tolist() for x in alignment.merge_ends(np.array(a, int), np.array(b, int))))) == want
