"""Alignment of two tokenizers by the byte offsets at which tokens of both end.

Inside ``mapInArrow`` the cumulative token ends of both sides are merged; offsets that both have
cut a document into groups, and the tokens that end there are linked.  Spark counts the linked id
pairs of the corpus, takes the maxima of each side, and gives both back to the documents: every
chunk of documents asks once for each of its different pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.chunks import Numbering, answered, runs
from framegrid.llm.common import materialise
from framegrid.llm.packing import CACHED_PIECES, SEEN, token_bytes, tokenizer

#: Links in a chunk.
CHUNK = 1 << 22

#: A run of blanks and what follows, up to the next blank; blanks at the end belong to the last one.
_UNIT = re.compile(r" +[^ ]+(?: +\Z)?| +\Z")
#: Texts with other characters than these are encoded whole, as are those with the sign for a blank.
_OTHER = re.compile(r"[^\t\n -~À-ÖØ-öø-ÿ]")

_sides: dict[tuple[str, str], Side] = {}
_pieces: dict[str, PieceSide] = {}
_written: dict[int, list[bytes]] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level tokenizers write bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Side:
    """Token bytes of a byte-level tokenizer, and ids of texts after a blank."""

    def __init__(self, path: str):
        self.path, byte = path, byte_alphabet()
        vocabulary = tokenizer(path, True).get_vocab(True)
        self.size = max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int64) for x in token_bytes([" " + t for t in texts], self.path, True)]


class PieceSide:
    """Token bytes of a sentencepiece model that puts a blank before texts, and ids of texts.

    Where no piece has a blank behind another character, no merge crosses such a place, so a text's
    ids are those of its units one after the other, and those of units that come again are kept.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(self.size)]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.by_unit = not any(re.search("[^▁]▁", n) for n in names)
        self.known: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)] if texts else []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
            self.seen[:] = bytes(SEEN)
        whole = [k for k, t in enumerate(texts) if not self.by_unit or _OTHER.search(t)]
        out = dict(zip(whole, self.encode([texts[k] for k in whole])))
        cut = {k: _UNIT.findall(" " + t) for k, t in enumerate(texts) if k not in out}
        new = list(set().union(*cut.values()).difference(self.known))
        self.known.update(zip(new, self.encode([u[1:] for u in new])))
        for k, units in cut.items():
            out[k] = b"".join(map(self.known.__getitem__, units))
        for u in new:  # most different units never come again
            at = hash(u) % SEEN
            if not self.seen[at]:
                self.seen[at] = 1
                del self.known[u]
        return [np.frombuffer(out[k], "<u4").astype(np.int64) for k in range(len(texts))]


def sides(a: str, b: str) -> tuple[Side, PieceSide]:
    """The two tokenizers, loaded once a worker."""
    if (a, b) not in _sides:
        _sides[a, b] = Side(a)
        _pieces[b] = PieceSide(b)
    return _sides[a, b], _pieces[b]


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising lists of token ends at which both have the same."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    hit = b[np.minimum(at, len(b) - 1)] == a
    return np.flatnonzero(hit), at[hit]


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3: ids of each group; ``last_a`` and ``last_b`` are the places at which groups end."""
    most = int(max(ids_a.max(), ids_b.max())) + 1
    size = 1 << (most - 1).bit_length()
    if size not in _written:
        _written[size] = [sep + b"%d" % k for sep in (b",", b";", b"|") for k in range(size)]
    first_a, first_b = np.r_[0, last_a[:-1] + 1], np.r_[0, last_b[:-1] + 1]
    row_a, row_b = ids_a.copy(), ids_b.copy()
    row_a[first_a] += size
    row_b[first_b] += 2 * size
    group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
    group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + first_b[group_a]] = row_a
    out[np.arange(len(ids_b)) + last_a[group_b] + 1] = row_b
    return b"".join(map(_written[size].__getitem__, out.tolist()))[1:]


def aligned(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """(chunk, id, n_a, n_b, n_groups, n_links, groups_sha256, links[, groups]): one row per document.

    ``a`` is a byte-level tokenizer's file, which gets a blank and the text, ``b`` a sentencepiece
    model, which adds the blank.  ``links`` are the linked pairs as packed numbers, id of a times
    b's size plus id of b.  Texts that are null, empty, or not given back by either side's tokens
    have no tokens.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(a, b)
        length_a, length_b = (np.array([len(x) for x in s.bytes]) for s in (left, right))
        packed = np.uint32 if left.size * right.size <= 1 << 32 else np.int64
        chunk = Numbering(CHUNK)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for t, x, y in zip(texts, left.ids(texts), right.ids(texts)):
                    whole = b" " + t.encode()
                    if not t or b"".join(map(left.bytes.__getitem__, x.tolist())) != whole or b"".join(map(right.bytes.__getitem__, y.tolist())) != whole:
                        rows.append((0, 0, 0, "", b"", ""))
                        continue
                    end_a, end_b = merge_ends(np.cumsum(length_a[x]), np.cumsum(length_b[y]))
                    groups = written_groups(x, y, end_a, end_b)
                    links = (x[end_a] * right.size + y[end_b]).astype(packed)
                    rows.append((len(x), len(y), len(end_a), hashlib.sha256(groups).hexdigest(), links.tobytes(), groups.decode() if with_groups else ""))
                n_a, n_b, n, digest, links, groups = map(list, zip(*rows))
                columns = [pa.array(chunk.of(np.array(n))), part.column(0), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n, n)), pa.array(digest, pa.string()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(groups, pa.string())] * with_groups, names=fields)

    schema = f"chunk long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary" + ", groups string" * with_groups
    fields = ["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"] + ["groups"] * with_groups
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def chunk_pairs(held: DataFrame, packed: type) -> DataFrame:
    """(chunk, key, n): the different pairs of a chunk and how often it links them, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, links = None, []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.frombuffer(b"".join(links), packed), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["chunk", "key", "n"])

        for number, rows in runs(batches, 4096):
            if number != chunk and links:
                yield flush()
                links = []
            chunk = number
            links += rows.column("links").to_pylist()
        if links:
            yield flush()

    return materialise(held.select("chunk", "links").mapInArrow(run, "chunk long, key long, n long"), "linked-pairs", "zstd")


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(key, a, b, n, best_a, best_b): corpus-wide counts of linked pairs, and whether they are their a's or b's highest, ties included."""
    counts = pairs.groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts.select("key", F.expr(f"key div {size_b}").alias("a"), (F.col("key") % size_b).alias("b"), "n"), "pair-counts", "zstd")
    for side in ("a", "b"):  # maxima are at most as many as a vocabulary has ids
        most = counts.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
        counts = counts.join(F.broadcast(most), side)
    return counts.select("key", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def align(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """(id column, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256[, groups]): one row per document.

    ``n_best`` are the links whose corpus-wide count is the highest of their b id, ``n_best_a``
    those of their a id, ties included; ``count_sum`` adds the counts of all links.  Texts that are
    null, empty or not given back by the tokens of both sides have zeros and an empty digest;
    special tokens' strings in texts are plain text; repeated rows and null ids count and return as
    often as they come; other columns are ignored; an empty table gives an empty one.
    """
    left, right = sides(a, b)
    packed = np.uint32 if left.size * right.size <= 1 << 32 else np.int64
    kind = docs.schema[id].dataType.simpleString()
    held = materialise(aligned(docs, a, b, id, text, with_groups), "aligned", "zstd")
    pairs = chunk_pairs(held, packed)
    asked = pairs.select("chunk", "key").join(pair_counts(pairs, right.size), "key").select("chunk", "key", "n", "best_a", "best_b")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links"]
    tail = ["groups_sha256"] + ["groups"] * with_groups

    def prepare(pairs: list) -> tuple:
        order = np.argsort(pairs[0])
        return tuple(c[order].astype(np.int64) for c in pairs)

    def kernel(tables: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, *values = tables
        sums = []
        for links in rows.column("links").to_pylist():
            at = np.searchsorted(keys, np.frombuffer(links, packed).astype(np.int64))
            sums.append([int(v[at].sum()) if len(at) else 0 for v in values])
        count, best_a, best_b = (pa.array(list(c), pa.int64()) for c in zip(*sums))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), best_b, best_a, count, *(rows.column(c) for c in tail)], names=[*kept, "n_best", "n_best_a", "count_sum", *tail])

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return answered(held, [asked], prepare, kernel, schema).withColumnRenamed("id", id)
