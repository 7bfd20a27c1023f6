"""Substring dedup with repeated-phrase automata.

Windows of consecutive words that recur in other documents are found and removed from all but
the document of smallest id.  Windows are dealt to shards by their minimizer, the five-word run
of smallest hash within the window, so that equal windows always meet.  A shard confirms which of
its windows recur, compiles them into an Aho-Corasick automaton over its own numbered phrases, and
streams its stretches of all documents through it to locate every occurrence.

Only stretches whose minimizer occurs in different texts are dealt at all, and those of very
common ones singly, window by window, so that no shard gets all stretches around a common phrase.
As long as the counted minimizers fit, two filters of fixed size tell which are which; beyond
that every document's own minimizers are joined with the counted ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrid.llm.common import M3, materialise, mix, only_ids, spread_join

#: Words of a window and of its minimizer.
WINDOW, RUN = 13, 5
#: An automaton's letters are numbered runs of so many words: a window is then five letters, not thirteen.
PHRASE = 9
#: Bits of each filter that is sent to every task, and the share of them at most that may be set.
FILTER_BITS, FILTER_FULL = 1 << 25, 1 / 8
#: A minimizer that occurs more often than this has its windows dealt singly; windows that a shard gets on average.
COMMON, SHARD = 5000, 150_000

_NONE = np.iinfo(np.int64).max


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * M3 + h[k : len(h) - size + 1 + k])
    return out


def minimizers(h: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For every window the place and hash of its minimizer (the leftmost of the smallest)."""
    runs = run_hashes(h, run)
    n = len(h) - window + 1
    least, at = runs[:n].copy(), np.arange(n)
    for k in range(1, window - run + 1):
        less = runs[k : k + n] < least
        least[less] = runs[k : k + n][less]
        at[less] = np.flatnonzero(less) + k
    return at, least


def text_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63


def _minimizer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, fp, then the batch's other columns) of every different minimizer of every text."""
    for batch in batches:
        keys, fps, places = [], [], []
        for i, x in enumerate(batch.column("t").to_pylist()):
            words = (x or b"").split()
            if len(words) >= WINDOW:
                own = np.unique(minimizers(word_hashes(words))[1]).astype(np.int64)
                keys.append(own)
                fps.append(np.full(len(own), text_hash(words)))
                places.append(np.full(len(own), i))
        if keys:
            at = pa.array(np.concatenate(places))
            others = [n for n in batch.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps)), *(batch.column(n).take(at) for n in others)], names=["m", "fp", *others])


def _listed(bare: DataFrame, found: DataFrame) -> DataFrame:
    """``bare`` with the counted minimizers that each row's text has: ``ms`` and, of each, whether it is ``common``."""
    named = bare.withColumn("own", F.xxhash64("t"))
    rows = named.where("id is not null").mapInArrow(_minimizer_rows, "m long, fp long, id long, own long").drop("fp")
    kept = spread_join(materialise(rows, "minimizer-rows"), found, ["m"], ["id", "own"])
    lists = kept.groupBy(F.col("id").alias("_i"), F.col("own").alias("_o")).agg(F.collect_list(F.struct("m", "common")).alias("l"))
    joined = named.join(lists, (F.col("id") == F.col("_i")) & (F.col("own") == F.col("_o")), "left")
    return joined.select("id", "t", F.coalesce("l.m", F.array().cast("array<long>")).alias("ms"), F.coalesce("l.common", F.array().cast("array<boolean>")).alias("common"))


def _filters(found: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of the slots of shared and of common minimizers; at most bits / 32 rows come to the driver."""
    slots = found.select(F.shiftrightunsigned("m", 1).alias("s"), "common").select(F.pmod("s", F.lit(bits)).alias("s"), "common")
    bit = F.expr("shiftleft(1L, int(s % 32))")
    words = slots.groupBy(F.floor(F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(bit).alias("b"), F.coalesce(F.bit_or(F.when(F.col("common"), bit)), F.lit(0)).cast("long").alias("c"))
    shared, common = np.zeros(bits // 32, np.uint32), np.zeros(bits // 32, np.uint32)
    for part in words.mapInArrow(lambda batches: batches, words.schema).toArrow().to_batches():
        at = part.column(0).to_numpy()
        shared[at], common[at] = part.column(1).to_numpy().astype(np.uint32), part.column(2).to_numpy().astype(np.uint32)
    return shared, common


def _among(listed: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.isin(m.view(np.int64), listed)


def _in(table: np.ndarray, bits: int, m: np.ndarray) -> np.ndarray:
    slot = (m >> np.uint64(1)) % np.uint64(bits)
    return (table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def stretches(words: list[bytes], shared: Callable, common: Callable) -> list[tuple[int, int, int]]:
    """(key, first window, windows) of the stretches to deal out: windows with one minimizer, or single windows of common ones.

    ``shared`` and ``common`` tell of an array of minimizers which are so.
    """
    h = word_hashes(words)
    at, m = minimizers(h)
    keep = shared(m)
    if not keep.any():
        return []
    single = keep & common(m)
    out = []
    if single.any():
        own = np.flatnonzero(single)
        keys = mix(run_hashes(h, WINDOW)[own]).astype(np.int64)
        out += [(int(k), int(i), 1) for k, i in zip(keys, own)]
    rest = np.flatnonzero(keep & ~single)
    if len(rest):
        edge = np.flatnonzero(np.r_[True, (np.diff(at[rest]) != 0) | (np.diff(rest) != 1)])
        ends = np.r_[edge[1:], len(rest)]
        out += [(int(m[rest[a]].astype(np.int64)), int(rest[a]), int(b - a)) for a, b in zip(edge, ends)]
    return out


def locate(units: pd.DataFrame) -> pd.DataFrame:
    """Confirm, compile, stream: for every unit the smallest id with each of its recurring windows.

    ``units`` has text (words joined by spaces), low and high (smallest and largest id of the
    unit's documents).  Windows that only one document has are not in the automaton.
    """
    words = [t.split(b" ") for t in units["text"]]
    lengths = np.array([len(x) for x in words])
    line = word_hashes([w for x in words for w in x])
    of = np.repeat(np.arange(len(words)), lengths)
    own = of[: len(line) - WINDOW + 1]
    inside = np.flatnonzero(own == of[WINDOW - 1 :])  # windows within one unit
    windows = run_hashes(line, WINDOW)[inside]
    order = np.argsort(windows, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(windows[order].view(np.int64)) != 0])
    unit = own[inside][order]
    low = np.minimum.reduceat(units["low"].to_numpy()[unit], edge)
    high = np.maximum.reduceat(units["high"].to_numpy()[unit], edge)
    recurs = np.flatnonzero(low < high)
    places, low = inside[order[edge[recurs]]].tolist(), low[recurs].tolist()
    # A node's children are searched in turn, so a phrase's number is written in three letters of small alphabets.
    number = np.unique(run_hashes(line, PHRASE), return_inverse=True)[1]
    digits = np.stack((number >> 16 & 0xFFFF, number >> 8 & 0xFF, number & 0xFF), axis=1) + np.array([0x10000, 0x100, 0x200])
    letters = digits.astype("<u4").tobytes().decode("utf-32-le")
    size = WINDOW - PHRASE + 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, at in enumerate(places):
        automaton.add_word(letters[3 * at : 3 * (at + size)], k)
    if places:
        automaton.make_automaton()
    firsts, at = [], 0
    for length in lengths.tolist():
        first = [_NONE] * (length - WINDOW + 1)
        for end, k in automaton.iter(letters[3 * at : 3 * (at + length - PHRASE + 1)]) if places else ():
            first[end // 3 - size + 1] = low[k]
        firsts.append(first)
        at += length
    return pd.DataFrame({"key": units["key"], "th": units["th"], "firsts": firsts})


def kept_words(words: list[bytes], starts: list[int]) -> list[bytes]:
    """The words that no window starting at one of ``starts`` covers."""
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(starts, dtype=np.int64))
    gone[at] += 1
    np.subtract.at(gone, at + WINDOW, 1)
    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in left]


def recurring_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents (id, fp, n_words, sha256, whole) and the windows to remove (id, fp, starts).

    ``whole`` marks documents that are removed whole, as exact copies, by words, of one of smaller id.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    rows = bare.select("t").mapInArrow(_minimizer_rows, "m long, fp long")
    found = rows.groupBy("m").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("a <> b").select("m", (F.col("n") > COMMON).alias("common"))
    found = materialise(found, "minimizers")
    tables = None
    if found.count() <= bits * FILTER_FULL:
        tables = spark.sparkContext.broadcast(_filters(found, bits))
    else:
        bare = _listed(bare, found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [partial(_in, table, bits) for table in tables.value] if tables else []
        for batch in batches:
            fps, ns, shas, keys, starts, sizes, texts, ths, ends = [], [], [], [], [], [], [], [], [0]
            for at, x in enumerate(batch.column("t").to_pylist()):
                words = (x or b"").split()
                line = b" ".join(words)
                fps.append(xxhash.xxh3_64_intdigest(line) - 2**63)
                ns.append(len(words))
                shas.append(hashlib.sha256(line).hexdigest())
                if not tables:
                    ms, often = (np.array(batch.column(c)[at].as_py(), dtype=kind) for c, kind in (("ms", np.int64), ("common", bool)))
                    tests = [partial(_among, ms), partial(_among, ms[often])]
                for k, i, n in stretches(words, *tests) if len(words) >= WINDOW else ():
                    part = b" ".join(words[i : i + n + WINDOW - 1])
                    keys.append(k), starts.append(i), sizes.append(n), texts.append(part), ths.append(xxhash.xxh3_64_intdigest(part) - 2**63)
                ends.append(len(keys))
            flat = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(ths, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], names=["key", "th", "start", "n", "text"])
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(shas, pa.string()), parts], names=["id", "fp", "n_words", "sha256", "parts"])

    scanned = materialise(bare.mapInArrow(scan, "id long, fp long, n_words long, sha256 string, parts array<struct<key:long,th:long,start:int,n:int,text:binary>>"), "stretches")
    table = scanned.select("id", "fp", "n_words", "sha256")
    same = ["fp", "n_words", "sha256"]
    first = table.where("id is not null").groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    whole = F.coalesce((F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW), F.lit(False))
    table = spread_join(table, first, same, ["id"], "left").select("id", *same, whole.alias("whole"))

    parts = scanned.where("id is not null and size(parts) > 0").select("id", "fp", F.explode("parts").alias("p"))
    units = parts.groupBy("p.key", "p.th", "p.text").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    n_windows = scanned.where("size(parts) > 0").agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"]))).first()[0] or 0
    shards = max(1, -(-n_windows // SHARD))
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    firsts = dealt.groupBy("shard").applyInPandas(locate, "key long, th long, firsts array<long>")
    firsts = materialise(firsts.where(F.exists("firsts", lambda x: x < _NONE)), "windows")
    placed = parts.select("id", "fp", "p.start", "p.key", "p.th")
    hits = spread_join(placed, firsts, ["key", "th"], ["id", "start"])
    hits = hits.select("id", "fp", F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull()).alias("starts"))
    hits = hits.where(F.size("starts") > 0).groupBy("id", "fp").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return table, hits


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """(id column, n_words, n_removed, kept_sha256): one row per row of ``docs``.

    A word goes if it is covered by a window of 13 words whose word sequence also starts in a
    document of smaller id.  The digest is of the words kept, joined by one space.  Null, empty
    and blank texts have no words; documents of fewer than 13 words stay as they are; a null id
    is compared with nothing; repeated rows give equal results and don't remove each other; other
    columns are ignored; an empty table gives an empty one.
    """
    table, hits = recurring_windows(docs, id, text, bits)
    hits = materialise(hits, "hits")
    bare = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    texts = only_ids(bare.where("id is not null"), hits.select("id").distinct(), "id").distinct()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, ns, shas = [], [], [], []
            for i, fp, x, starts in zip(*(batch.column(k).to_pylist() for k in ("id", "fp", "t", "starts"))):
                words = (x or b"").split()
                if text_hash(words) == fp:
                    kept = kept_words(words, starts)
                    ids.append(i), fps.append(fp), ns.append(len(words) - len(kept)), shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(shas, pa.string())], names=["id", "fp", "n", "sha"])

    removed = texts.join(hits, "id").select("id", "fp", "t", "starts").mapInArrow(remove, "id long, fp long, n long, sha string").distinct()
    out = table.join(removed, ["id", "fp"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("id").alias(id), "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_removed"), F.when(F.col("whole"), F.lit(nothing)).otherwise(F.coalesce("sha", "sha256")).alias("kept_sha256"))


def removed_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the texts' recurring words removed: the same columns, words joined by one space where any went.

    One row per row of ``docs``: repeated rows stay, and of an id with several texts each is cut by
    its own windows.  Null texts and rows with a null id stay as they are; texts without a window
    keep their blanks; an empty table gives an empty one.
    """
    table, hits = recurring_windows(docs, id, text)
    gone = table.where("whole").select("id", "fp", F.expr(f"sequence(0, int(n_words) - {WINDOW})").alias("starts"))
    every = hits.join(gone, ["id", "fp"], "left_anti").unionByName(gone).dropDuplicates(["id", "fp"])
    every = materialise(every, "starts").withColumnsRenamed({"id": "_fg_id", "fp": "_fg_own", "starts": "_fg_starts"})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_hash((x or "").encode().split()) for x in batch.column(text).to_pylist()]
            yield batch.append_column("_fg_fp", pa.array(fps, pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index(text)
            out = []
            for x, starts in zip(*(batch.column(k).to_pylist() for k in (text, "_fg_starts"))):
                out.append(x if starts is None else b" ".join(kept_words((x or "").encode().split(), starts)).decode())
            yield batch.set_column(place, text, pa.array(out, pa.string()))

    named = docs.mapInArrow(name, T.StructType([*docs.schema.fields, T.StructField("_fg_fp", T.LongType())]))
    joined = named.join(every, (F.col(id).cast("long") == F.col("_fg_id")) & (F.col("_fg_fp") == F.col("_fg_own")), "left")
    return joined.mapInArrow(cut, joined.schema).select(*docs.columns)
