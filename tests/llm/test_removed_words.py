"""Texts with their recurring words removed: repeated rows and repeated ids."""

from framegrid.llm import substrings

COMMON = " ".join(f"c{k}" for k in range(14))


def test_removed_words_keeps_rows(spark):
    a, b = f"one  {COMMON} x", f"{COMMON} another end"
    rows = [(1, f"start {COMMON}", "s"), (2, a, "s"), (2, a, "s"), (3, a, "t"), (4, a, "s"), (4, b, "s"), (4, "short  text", "s"), (5, f"start {COMMON}", "s"), (5, f"start  {COMMON}", "s"), (6, "no  match", "s"), (None, a, "s"), (None, a, "s"), (7, None, "s"), (7, "", "s")]
    want = [(1, f"start {COMMON}", "s"), (2, "one x", "s"), (2, "one x", "s"), (3, "", "t"), (4, "", "s"), (4, "another end", "s"), (4, "short  text", "s"), (5, "", "s"), (5, "", "s"), (6, "no  match", "s"), (None, a, "s"), (None, a, "s"), (7, None, "s"), (7, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = substrings.removed_words(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert substrings.removed_words(docs.limit(0)).count() == 0


def test_joined_minimizers_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, COMMON), (None, None), (3, COMMON)], docs.schema))
    a, b = (sorted(map(repr, substrings.dedup_substrings(docs, bits=n).collect())) for n in (1 << 25, 32))
    assert a == b and len(a) == docs.count()
