"""Quality rules with verdicts by host.

Every text gets rule counts in one pass.  Failures are aggregated by host, each host's failure
rates are shrunk towards all hosts' with a beta prior fitted to the hosts themselves (method of
moments), and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import materialise

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(rb"[#*$%&|<>]")

#: Rules beside the base rule; a document fails one if its expression holds.
RULES = {
    "base": "base_failed",
    "symbols": "n_symbols > 0.1 * greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines > 0.3 * greatest(n_lines, 1)",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of one UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(seen := Counter(triples)) < len(triples):
        upto = 0
        for i, t in enumerate(triples):
            if seen[t] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x) for x in batch.column("_fg_text").to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * 6
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "host", *names])


def document_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, counts, base_failed): one row per row of ``docs``; a null text counts as empty."""
    bare = docs.select(F.col(id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("binary").alias("_fg_text"))
    out = bare.mapInArrow(_counted, f"doc_id {docs.schema[id].dataType.simpleString()}, host string, {SCHEMA}")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def beta_prior(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """One row with alpha and beta by rule: the beta distribution with the hosts' mean and between-host variance.

    The mean is that of all documents; the sampling variance of rates is taken off the variance
    between hosts.  Hosts that don't differ give a strong prior (1e6 documents).
    """
    aggs = []
    for r in rules:
        f, n = F.col(f"f_{r}"), F.col("n")
        aggs += [F.sum(f).alias(f"F_{r}"), F.sum(f * f / n).alias(f"Q_{r}")]
    total = hosts.agg(F.sum("n").alias("N"), F.count("*").alias("H"), F.sum(F.col("n") * F.col("n")).alias("N2"), *aggs)
    cols = []
    for r in rules:
        mean = F.col(f"F_{r}") / F.col("N")
        between = F.col(f"Q_{r}") - F.col(f"F_{r}") * F.col(f"F_{r}") / F.col("N") - (F.col("H") - 1) * mean * (1 - mean)
        scale = F.col("N") - F.col("N2") / F.col("N")
        var = F.when(scale > 0, between / scale)
        size = F.when(var > 0, F.least(F.lit(1e6), F.greatest(F.lit(1e-6), mean * (1 - mean) / var - 1))).otherwise(F.lit(1e6))
        cols += [(mean * size).alias(f"a_{r}"), ((1 - mean) * size).alias(f"b_{r}")]
    return total.select(*cols)


def host_verdicts(counts: DataFrame, rules: dict[str, str] = RULES, worst: float = 0.5) -> DataFrame:
    """(host, n, f_*, rate_*, host_failed): a host fails if a rule's shrunk failure rate is above ``worst``."""
    hosts = counts.groupBy("host").agg(F.count("*").cast("long").alias("n"), *(F.sum(F.expr(e).cast("long")).alias(f"f_{r}") for r, e in rules.items()))
    prior = beta_prior(hosts, list(rules))
    shrunk = hosts.crossJoin(F.broadcast(prior))  # one row
    rates = {r: (F.col(f"f_{r}") + F.col(f"a_{r}")) / (F.col("n") + F.col(f"a_{r}") + F.col(f"b_{r}")) for r in rules}
    failed: Column = F.lit(False)
    for x in rates.values():
        failed = failed | (x > worst)
    return shrunk.select("host", "n", *(f"f_{r}" for r in rules), *(x.alias(f"rate_{r}") for r, x in rates.items()), failed.alias("host_failed"))


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", worst: float = 0.5) -> DataFrame:
    """Rule counts, ``base_failed``, ``host_failed`` and ``kept`` of every row of ``docs``.

    A document is kept if it passes the base rule and its host has no rule whose shrunk failure
    rate is above ``worst``.  Null texts are empty and fail the base rule; a null host is a host
    of its own; repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty one.  The counts are written once to the shared folder, since they are read
    for the hosts and again for the documents.
    """
    counts = materialise(document_counts(docs, id, text, host), "rules")
    verdicts = host_verdicts(counts, worst=worst).select(F.col("host").alias("_fg_host"), "host_failed")
    joined = counts.join(verdicts, F.col("host").eqNullSafe(F.col("_fg_host")), "left").drop("_fg_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
