"""Contexts of seeds in texts without digits, and of any length."""

import pytest

from framegrid.llm import pii


def identifiers(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.n_id for r in pii.find_pii(docs).collect()}, {r.doc_id: r.text for r in pii.redact(docs).collect()}


def test_emails_in_texts_without_digits(spark):
    names = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(100)]
    rows = [(i, f"please write to member number {n}@ex.org {'at 9' if i % 10 == 0 else 'today'}") for i, n in enumerate(names)]
    n, kept = identifiers(spark, [*rows, (200, "please write to member number AB-17731-X today")])
    assert n[200] == 1 and kept[200] == "please write to member number <id> today"
    assert kept[1] == "please write to member number <email> today"


@pytest.mark.parametrize("between", [" " * 300, " http://ex.org/" + "a" * 400 + " "])
def test_long_contexts(spark, between):
    rows = [(i, f"for 1 member{between}u{i}@ex.org today") for i in range(20)]
    n, kept = identifiers(spark, [*rows, (200, f"for 1 member{between}AB-17731-X today")])
    assert n[200] == 1 and kept[200] == f"for 1 member{between}<id> today"


def test_pattern_needs_two_whole_words():
    for head in ("a", "a ", " a ", "a b", "x" * 900 + " ", "a b c="):
        assert pii._pattern(head + "u1@ex.org", len(head)) is None
    for pad in range(150, 260):
        head = "x" * pad + "  member number ("
        assert pii._pattern(head + "u1@ex.org", len(head)) == pii._pattern("member number u1@ex.org", 14)
        head = "y " + "x" * pad + " "
        assert pii._pattern(head + "u1@ex.org", len(head)) == pii.pair_hash(pii.crc32(b"y"), pii.crc32(b"x" * pad))
