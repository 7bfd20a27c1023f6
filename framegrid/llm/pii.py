"""Personal data: fixed patterns, and identifiers found from their contexts by bootstrapping.

The fixed kinds (email, ip, card, phone) are the seeds.  The two words before a seed or before
any identifier-shaped word are its lexical pattern.  Spark scores the graph of patterns and
instances in rounds: a pattern's confidence is the score of the instances it introduces, taken
over all times it occurs in the corpus, whatever follows it; an instance's score comes from its
patterns.  Identifier-shaped words after patterns of high confidence become spans of kind "id".
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import materialise, small

# Fixed patterns of the four kinds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Whole runs within which the matches of a kind lie; each is read once, however long.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/-]{4,}[A-Za-z0-9]")
#: Words of an unseen identifier have at least this many digits.
DIGITS = 3
#: Rounds of scoring; confidence and different instances that a pattern needs.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 3
#: Spans of at most so many bytes, counted first, are broadcast to the documents; more are joined by a shuffle.
BROADCAST_BYTES = 32_000_000
#: Bits of the filter of pattern hashes that is sent to every task, whatever the size of the corpus.
FILTER_BITS = 1 << 22

OCC = "array<struct<start:int,end:int,seed:boolean,instance:string,pattern:long>>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, tried once at every @, from the start of the run of local characters before it.

    All that comes before the @ in that run can start a match equally, so the leftmost match
    begins where the run begins, or where the match before it ends.
    """
    at = 0
    while (sign := text.find("@", at)) >= 0:
        m = PATTERNS["email"].match(text, at + len(text[at:sign].rstrip(_LOCAL)))
        if m:
            yield m.span()
        at = m.end() if m else sign + 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a whole run of dotted numbers, from its first on, whose values are at most 255."""
    for run in _DOTTED.finditer(text) if "." in text else ():
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in own) and all(int(p.lstrip("0") or "0") <= 255 for p in own):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _GROUPED.finditer(text):
        if run.end() - run.start() >= 12:
            digits = run.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PATTERNS["phone"].finditer(text) if "+" in text else ():
        if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of valid fixed matches, by start and then kind; leftmost, not overlapping within a kind."""
    finders = [_emails, _ips, _cards, _phones] if _DIGIT.search(text) else [_emails]
    return sorted((a, k, b) for k, find in enumerate(finders) for a, b in find(text))


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def _pattern(text: str, at: int) -> int | None:
    """Hash of the two whole words before a span that starts at ``at``, A-Z lower-cased, or None.

    Opening quotes and brackets right before the span belong to it; any other piece of a word
    there, or fewer than two words, gives no pattern.  Words and blanks may be of any length: the
    part looked at grows until it holds two words that it surely doesn't cut.
    """
    size = 200
    while True:
        head = text[max(0, at - size) : at]
        before = head.encode("utf-8", "replace").lower().split()
        if before and not head[-1] in " \t\n\v\f\r" and before.pop().strip(b"\"'([{<"):
            return None
        if len(before) >= 2 + (at > size):
            return pair_hash(crc32(before[-2]), crc32(before[-1]))
        if at <= size:
            return None
        size *= 4


def pair_hash(a, b):
    """63-bit hash of two word hashes; works on ints and, with wrap-around, on uint64 arrays."""
    if isinstance(a, np.ndarray):
        return ((a << np.uint64(31)) ^ b).astype(np.int64)
    return (a << 31) ^ b


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-shaped words that no seed overlaps, each with its instance and pattern."""
    out = [(a, b, True) for a, _, b in spans]
    place, upto = 0, 0  # spans and words are both in order: the furthest end of the spans that start before a word
    for m in _WORD.finditer(text) if _DIGIT.search(text) else ():
        w = m.group()
        if len(w) > 5 and sum(map(w.count, "0123456789")) >= DIGITS and (x := _IDENTIFIER.search(w)):
            a, b = m.start() + x.start(), m.start() + x.end()
            while place < len(spans) and spans[place][0] < b:
                upto = max(upto, spans[place][2])
                place += 1
            if upto <= a and sum(map(x.group().count, "0123456789")) >= DIGITS:
                out.append((a, b, False))
    rows = []
    for a, b, seed in sorted(out):
        if (p := _pattern(text, a)) is not None:
            rows.append({"start": a, "end": b, "seed": seed, "instance": text[a:b].lower(), "pattern": p})
    return rows


def scan(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, fp, n_*, base_sha256, base, occ) of every row; ``fp`` is a hash of the text."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("pattern", pa.int64())]))]
        for batch in batches:
            rows = []
            for x in (v.as_py() for v in batch.column("t")):
                spans = base_spans(x)
                line = joined(spans)
                n = Counter(k for _, k, _ in spans)
                rows.append((*(n[k] for k in range(4)), hashlib.sha256(line.encode()).hexdigest(), line, occurrences(x, spans)))
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "base", "occ"]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "fp", *names])

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id).alias("doc_id"), F.xxhash64(t).alias("fp"), t.alias("t")).mapInArrow(run, f"doc_id {kind}, fp long, {counts}, base_sha256 string, base string, occ {OCC}")


def pattern_totals(docs: DataFrame, text: str, patterns: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(pattern, total): how often each two-word context occurs in all texts, whatever follows it.

    Tasks count only contexts that pass a hash filter of the wanted ones.  The filter has a fixed
    size; with more patterns it lets more contexts through and the exact join still decides.
    """
    slot = F.pmod(F.col("pattern").bitwiseXOR(F.shiftright("pattern", 31)), F.lit(bits))
    words = patterns.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(slot % 32)))").alias("b"))
    table = np.zeros(bits // 32, np.uint32)
    for r in words.toLocalIterator():  # at most bits / 32 rows
        table[r["w"]] = r["b"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            counts: list[np.ndarray] = []
            for x in (v.as_py() for v in batch.column(0)):
                words = (x or b"").lower().split()
                if len(words) > 2:
                    h = np.fromiter(map(crc32, words), np.uint64, len(words))
                    p = pair_hash(h[:-2], h[1:-1])
                    at = (p ^ (p >> 31)) % bits
                    counts.append(p[(table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1])
            if counts:
                keys, n = np.unique(np.concatenate(counts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    found = docs.select(F.col(text).cast("binary")).mapInArrow(run, "pattern long, n long")
    return found.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi")


def confident_patterns(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """Patterns that score at least ``confident`` after so many rounds over the pattern-instance graph.

    ``edges`` is (pattern, instance, seed, n), one row per pattern and instance.  Seeds score 1
    throughout; others start at 0 and get the chance that at least one of their patterns is right.
    """
    known = edges.join(totals, "pattern")
    instances = edges.where("not seed").select("instance").distinct().withColumn("score", F.lit(0.0))
    scored = None
    for k in range(rounds):
        s = known.join(instances, "instance", "left").withColumn("s", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))))
        good = F.count(F.when(F.col("s") >= 0.5, 1))
        scored = s.groupBy("pattern").agg((F.sum(F.col("n") * F.col("s")) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence"), good.alias("good"))
        scored = materialise(scored.where(F.col("good") >= support), f"patterns-{k}")
        if k + 1 < rounds:
            doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))
            instances = edges.where("not seed").join(scored, "pattern").groupBy("instance").agg((1 - doubt).alias("score"))
    return scored.where(F.col("confidence") >= confident).select("pattern")


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", **scoring) -> DataFrame:
    """doc_id, fp, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id: one row per row of ``docs``.

    ``spans`` lists all spans as kind:start:end (code points, end exclusive) by start and then
    kind, joined by commas; base spans always stay and kind "id", found from contexts, comes
    last.  Null and empty texts have none; repeated rows get equal results; null ids are kept;
    other columns are ignored; an empty table gives an empty one.  Texts are read twice: for
    occurrences, and to count their contexts.
    """
    rows = materialise(scan(docs, id, text), "pii")
    occ = rows.where(F.size("occ") > 0).select("doc_id", "fp", F.explode("occ").alias("o")).select("doc_id", "fp", "o.*")
    edges = occ.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialise(edges, "pii-edges")
    wanted = edges.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= scoring.get("support", SUPPORT)).select("pattern")
    wanted = materialise(wanted, "pii-wanted")
    sure = confident_patterns(edges, materialise(pattern_totals(docs, text, wanted), "pii-totals"), **scoring)
    extra = occ.where("not seed").join(F.broadcast(sure) if small(sure) else sure, "pattern").select("doc_id", "fp", "start", "end").distinct()
    found = extra.groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.collect_list(F.struct("start", "end")).alias("more"))
    both = rows.drop("occ").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")), "left")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("x")))
    added = F.transform("more", lambda x: F.struct(x["start"].alias("start"), F.lit(5).cast("long").alias("k"), F.concat_ws(":", F.lit("id"), x["start"], x["end"]).alias("x")))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(base, added)), lambda x: x["x"]), ","))
    return both.withColumn("spans", spans).withColumn("n_id", F.coalesce(F.size("more"), F.lit(0)).cast("long")).withColumn("n_id", F.greatest("n_id", F.lit(0))).drop("_d", "_f", "more", "base")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in ((t.as_py(), s.as_py()) for t, s in zip(batch.column("_fg_text"), batch.column("_fg_spans"))):
            if spans:
                parts, at = [], 0
                for kind, a, b in sorted((x.split(":") for x in spans.split(",")), key=lambda x: (int(x[1]), -int(x[2]))):
                    a, b = int(a), int(b)
                    if a >= at:
                        parts += [text[at:a], f"<{kind}>"]
                    at = max(at, b)
                text = "".join((*parts, text[at:]))
            out.append(text)
        place = batch.schema.names.index("_fg_text")
        yield batch.set_column(place, "_fg_text", pa.array(out, pa.string()))


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **scoring) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, is counted again.

    Spans that overlap give one replacement, the first and longest.  Only rows with spans are
    joined with them; all other rows pass as they are.  Null and empty texts stay as they are,
    repeated rows and rows with a null id are replaced alike, columns of any other name keep
    their values, and an empty table gives an empty one.
    """
    spans = find_pii(docs, id, text, **scoring).where("spans <> ''").select(F.col("doc_id").alias("_fg_id"), F.col("fp").alias("_fg_fp"), F.col("spans").alias("_fg_spans")).distinct()
    spans = materialise(spans, "pii-spans")
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.length("_fg_spans")), F.lit(0))).first()
    side = F.broadcast(spans) if 64 * n + size <= BROADCAST_BYTES else spans
    with_spans = docs.join(side, F.col(id).eqNullSafe(F.col("_fg_id")) & (own == F.col("_fg_fp")), "left").drop("_fg_id", "_fg_fp")
    held = with_spans.withColumnRenamed(text, "_fg_text")
    out = held.mapInArrow(_replaced, held.schema).withColumnRenamed("_fg_text", text)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col("_fg_spans").isNull(), F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType)))
    return out.select(*docs.columns)
