"""Language-model scores by prediction by partial matching, and by unigrams.

The model is a trie of byte contexts up to ``ORDER`` bytes long, learned from all training
documents.  A byte not seen after a context costs an escape (method C: different bytes seen, over
these and all seen) to the next shorter context, where the bytes that the longer one had seen are
excluded; below the empty context all remaining bytes are alike.  A text ends with an own symbol.

Spark counts the contexts with their next bytes; the trie is cut into shards by the last
``SHARD`` bytes of contexts, each of which is bounded, and gives every pair of context and next
byte its code length; chunks of documents then ask for the lengths of theirs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.chunks import Numbering, answered, runs
from framegrid.llm.common import materialise

#: Bytes of the longest contexts (3 to 6), and of those that name a shard.
ORDER, SHARD = 4, 3
#: A symbol has nine bits; this one ends texts, and stands before their start in contexts.
BITS, END = 9, 256
SYMBOLS = 257
#: Bytes of text in a chunk, and symbols that are looked at together.
CHUNK, SLICE = 1 << 25, 1 << 22
#: Rows of the trie evaluated together, beyond which the next shard waits.
BUFFER = 400_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def parts_of(texts: list[bytes], order: int) -> Iterator[list[tuple[int, bytes, bytes, bool]]]:
    """Lists of (text's number, bytes before, bytes, whether the text ends here) of about SLICE bytes together; longer texts come in parts."""
    out, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), SLICE):
            part = text[at : at + SLICE]
            out.append((k, text[max(0, at - order) : at], part, at + SLICE >= len(text)))
            held += len(part) + order + 1
            if held >= SLICE:
                yield out
                out, held = [], 0
    if out:
        yield out


def codes_of(parts: list[tuple[int, bytes, bytes, bool]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols with their contexts, and how many each part has.

    A code holds the byte before in its highest place, those further back below, the symbol in its
    lowest: in order of the codes, contexts that end alike stand side by side.
    """
    blank = bytes(order)
    flat = np.frombuffer(b"".join(x for _, before, part, _ in parts for x in (blank[len(before) :], before, part, b"\0")), np.uint8).astype(np.int64)
    starts, at = [], 0
    use = np.ones(len(flat), bool)
    for _, before, part, ends in parts:
        first = at + order
        flat[at : first - len(before)] = END
        use[at:first] = False
        last = first + len(part)
        if ends:
            flat[last] = END
        else:
            use[last] = False
        starts.append(len(part) + int(ends))
        at = last + 1
    code = flat[order:].copy()
    for back in range(1, order + 1):
        code |= flat[order - back : len(flat) - back] << np.int64(BITS * (order + 1 - back))
    return code[use[order:]], np.array(starts, np.int64)


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys in order."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n[order], first)


def at_keys(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values at the wanted keys, 0 where a key isn't there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0)


def trie_logs(code: np.ndarray, n: np.ndarray, order: int, low: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of each code's symbol after its context.

    ``code`` are the pairs of longest contexts and symbols of whole shards, ``n`` their counts, 0
    for those met only outside of training; ``low`` has (code, n) for the orders below SHARD.
    """
    seen = n > 0
    symbol = code & ((1 << BITS) - 1)
    levels = dict(low)
    for k in range(SHARD, order + 1):
        cut = BITS * (order - k)
        levels[k] = merged((code[seen] >> np.int64(BITS + cut) << np.int64(BITS)) | symbol[seen], n[seen])
    logs, pending = np.zeros(len(code)), np.ones(len(code), bool)
    nodes_above, seen_above = None, None  # contexts one longer with how many different symbols follow them
    for k in range(order, -1, -1):
        keys, counts = levels[k]
        context = code >> np.int64(BITS * (order + 1 - k))
        nodes, of = np.unique(keys >> BITS, return_inverse=True)
        total = np.bincount(of, counts, len(nodes)).astype(np.int64)
        kinds = np.bincount(of, minlength=len(nodes)).astype(np.int64)
        t, d = at_keys(nodes, total, context), at_keys(nodes, kinds, context)
        if nodes_above is not None:
            above = code >> np.int64(BITS * (order - k))
            t = t - at_keys(nodes_above, excluded_from(levels[k + 1], nodes_above, levels[k]), above)
            d = d - at_keys(nodes_above, seen_above, above)
        c = at_keys(keys, counts, (context << np.int64(BITS)) | symbol)
        found, escape = pending & (c > 0), pending & (c == 0) & (d > 0)
        logs[found] += np.log10(c[found] / (t[found] + d[found]))
        logs[escape] += np.log10(d[escape] / (t[escape] + d[escape]))
        pending &= ~found
        nodes_above, seen_above = nodes, kinds
    rest = SYMBOLS - len(levels[0][0])
    if pending.any():
        logs[pending] -= log10(rest)
    return logs


def excluded_from(above: tuple[np.ndarray, np.ndarray], nodes: np.ndarray, below: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By context of ``above``: how often its symbols follow the context that is one shorter."""
    keys = above[0]
    context = keys >> BITS
    return np.bincount(np.searchsorted(nodes, context), at_keys(*below, (context >> BITS << BITS) | (keys & ((1 << BITS) - 1))), len(nodes)).astype(np.int64)


def code_lengths(grams: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 probability of every context and symbol among ``grams`` (key, n), a written table."""
    cut = BITS * order
    one = F.shiftright("key", cut).alias("c")
    few = grams.where("n > 0").groupBy(one, F.col("key").bitwiseAND((1 << BITS) - 1).alias("s")).agg(F.sum("n").alias("n")).collect()  # at most 257 x 257 rows
    first = merged(np.array([r["c"] << BITS | r["s"] for r in few], np.int64), np.array([r["n"] for r in few], np.int64))
    low = {1: first, 0: merged(first[0] & ((1 << BITS) - 1), first[1])}

    shard = F.shiftright("key", BITS * (order + 1 - SHARD))
    symbol = F.col("key").bitwiseAND((1 << BITS) - 1)
    # Contexts of two bytes: at most 257^2 with 257 symbols, whatever the corpus; each goes to the shards that end alike.
    two = grams.where("n > 0").groupBy(F.shiftright("key", BITS * (order - 1)).alias("two"), symbol.alias("s")).agg(F.sum("n").alias("n"))
    shards = grams.select(shard.alias("shard")).distinct().withColumn("two", F.shiftright("shard", BITS))
    copied = shards.join(two, "two").select("shard", F.lit(0).alias("part"), F.shiftleft("two", BITS).bitwiseOR(F.col("s")).alias("key"), "n")
    rows = grams.select(shard.alias("shard"), F.lit(1).alias("part"), "key", "n").unionByName(copied)

    def evaluate(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        part, key, n = (table.column(c).to_numpy() for c in ("part", "key", "n"))
        two_keys, at = np.unique(key[part == 0], return_index=True)
        own = part == 1
        logs = trie_logs(key[own], n[own], order, low | {2: (two_keys, n[part == 0][at])})
        return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(logs)], names=["key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows_held += batch.num_rows
            if rows_held >= BUFFER:
                table = pa.concat_tables(held).combine_chunks()
                number = table.column("shard").to_numpy()
                whole = int(np.searchsorted(number, number[-1]))  # the last shard may go on
                if whole:
                    yield evaluate([table.slice(0, whole)])
                held, rows_held = [table.slice(whole)], table.num_rows - whole
        if rows_held:
            yield evaluate(held)

    return rows.repartition("shard").sortWithinPartitions("shard", "part", "key").mapInArrow(run, "key long, value double")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def chunk_texts(docs: DataFrame, id: str, text: str, train: str | None, folds: int) -> DataFrame:
    """(chunk, id, held_out, text): whole texts in chunks, as a written table; null texts are empty."""
    kind = docs.schema[id].dataType.simpleString()
    out = F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds)) == 0, F.lit(True)) if train is None else ~F.coalesce(F.col(train), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Numbering(CHUNK)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = pc.binary_length(part.column(2)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(chunk.of(sizes)), *part.columns], names=["chunk", "id", "held_out", "text"])

    rows = docs.select(F.col(id).alias("id"), out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return materialise(rows.mapInArrow(run, f"chunk long, id {kind}, held_out boolean, text binary"), "scored-texts", "zstd")


def counted(held: DataFrame, order: int) -> DataFrame:
    """(chunk, key, word, n): every gram (key) and word of a chunk with its count in training texts, 0 for others; the word '' ends a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, grams, words = None, [], Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = merged(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))
            none = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys), none, pa.array(n)], names=["chunk", "key", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk)), pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["chunk", "key", "word", "n"])

        for number, rows in runs(batches, 256):
            if number != chunk and chunk is not None:
                yield from flush()
                grams, words = [], Counter()
            chunk = number
            texts, out = rows.column("text").to_pylist(), rows.column("held_out").to_pylist()
            for is_out in (False, True):
                own = [t for t, o in zip(texts, out) if o == is_out]
                for parts in parts_of(own, order):
                    keys, n = np.unique(codes_of(parts, order)[0], return_counts=True)
                    grams.append((keys, n * (not is_out)))
                for t in own:
                    if is_out:
                        words.update(dict.fromkeys(words_of(t), 0))
                    else:
                        words.update(words_of(t))
                words[b""] += len(own) * (not is_out)
            if sum(len(g[0]) for g in grams) > SLICE:
                grams = [merged(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))]
        if chunk is not None:
            yield from flush()

    return materialise(held.mapInArrow(run, "chunk long, key long, word binary, n long"), "counted", "zstd")


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", train: str | None = None, folds: int = 10, order: int = ORDER) -> DataFrame:
    """(id column, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document.

    Training documents are those whose boolean column ``train`` is true; without such a column all
    but those where crc32 of the id modulo ``folds`` is 0, and those without an id.  ``score`` is
    the log10 probability of the whole text's bytes and its end under the trie, ``base_score``
    that of its words, A-Z lower-cased, and the end under smoothed unigrams.  Null texts are
    empty; repeated rows count and are scored as often as they come; without training documents
    all symbols are alike; other columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema[id].dataType.simpleString()
    held = chunk_texts(docs, id, text, train, folds)
    found = counted(held, order)
    grams = found.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    lengths = code_lengths(materialise(grams, "grams", "zstd"), order)
    words = materialise(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words", "zstd")
    n, v = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    weighed = words.select("word", "n", F.log10((F.col("n") + 0.1) / (n + 0.1 * (v + 1))).alias("value"))
    asked_grams = found.where("key is not null").select("chunk", "key").join(lengths, "key").select("chunk", "key", "value")
    asked_words = found.where("word is not null").select("chunk", "word").join(weighed, "word")  # a chunk that two tasks read asks twice
    asked_words = asked_words.select("chunk", "word", "value", (F.col("n") > 0).alias("known"))

    def prepare(grams: list, words: list) -> tuple:
        keys, first = np.unique(grams[0], return_index=True)
        return keys, grams[1][first], {w: k for k, w in enumerate(words[0])}, words[1], words[2]

    def kernel(tables: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, values, number, weight, known = tables
        texts = rows.column("text").to_pylist()
        total = np.zeros(len(texts))
        for parts in parts_of(texts, order):
            code, sizes = codes_of(parts, order)
            logs = values[np.searchsorted(keys, code)]
            filled = sizes > 0
            sums = np.zeros(len(sizes))
            sums[filled] = np.add.reduceat(logs, (np.cumsum(sizes) - sizes)[filled])
            np.add.at(total, [p[0] for p in parts], sums)
        out = []
        for t in texts:
            at = np.fromiter(map(number.__getitem__, [*words_of(t), b""]), np.int64)
            out.append((len(at), int(known[at].sum()), float(weight[at].sum())))
        sizes, knowns, base = zip(*out)
        yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("held_out"), pa.array(sizes, pa.int64()), pa.array(knowns, pa.int64()), pa.array([n] * len(out), pa.int64()), pa.array(base, pa.float64()), pa.array(total)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered(held, [asked_grams, asked_words], prepare, kernel, fields).withColumnRenamed("id", id)


class AdaptiveTrie:
    """A trie that learns each symbol after having coded it; it starts empty."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def log10(self, before: tuple[int, ...], symbol: int) -> float:
        """log10 probability of ``symbol`` after ``before``, the bytes up to it."""
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(before[len(before) - k :], {})
            rest = {s: c for s, c in node.items() if s not in excluded}
            if rest:
                whole = sum(rest.values()) + len(rest)
                if symbol in rest:
                    return out + log10(rest[symbol] / whole)
                out += log10(len(rest) / whole)
                excluded |= rest.keys()
        return out - log10(SYMBOLS - len(excluded))

    def learn(self, before: tuple[int, ...], symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(before[len(before) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text and its end, learning on the way from the text alone: how far it repeats itself."""
    trie, before, out = AdaptiveTrie(order), (END,) * order, 0.0
    for symbol in (*text, END):
        out += trie.log10(before, symbol)
        trie.learn(before, symbol)
        before = (*before[1:], symbol) if order else ()
    return out


def adaptive_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id column, n_bytes, score): every text by a trie of its own that starts empty; edge cases as in ``score``."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(data)], pa.int64()), pa.array([adaptive_log10(data, order)])], names=["id", "n_bytes", "score"])

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, score double").withColumnRenamed("id", id)
