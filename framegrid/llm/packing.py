"""Best-fit packing with Martello-Toth reduction.

Spark tokenises, counts the pieces of each length, and places each piece.  Between the two, the
bin packing itself runs on the histogram of lengths, which has ``capacity`` entries however many
documents there are: dominance (Martello & Toth 1990, reduction procedure MTRP) fixes the sets
of one or two pieces that no other choice can beat, and best-fit decreasing packs the rest.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.llm.common import materialise

#: Pieces of one length are ranked in hashed buckets of about the first number, so that a hot length has no single
#: task; from as many buckets as the second number on, of about the third, so that the table of buckets stays small.
BUCKET, MANY, LARGE = 500, 4096, 100_000

#: Token bytes of about this many different pieces are kept in each Python worker, from the second time that a piece is met;
#: a table of so many hash slots tells which were met.
CACHED_PIECES, SEEN = 150_000, 1 << 23

#: So many new pieces are encoded as one string.
JOINED = 64

# Fixed: how the byte-level tokenizers cut a text into pieces, for ASCII and Latin-1 letters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t\n\r -~{_LETTERS}]")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters by which byte-level tokenizers write the bytes, from 0 to 255.
_BYTES = "".join(chr(b if b in _PLAIN else 256 + b - sum(x < b for x in _PLAIN)) for b in range(256))

_tokenizers: dict[tuple[str, bool], object] = {}
_joiners: dict[tuple[str, bool], tuple | None] = {}
_pieces: dict[tuple[str, bool], tuple[dict[str, bytes], np.ndarray]] = {}


def tokenizer(path: str, plain: bool = False):
    """The tokenizer of a file, loaded once a worker; with ``plain`` special tokens' strings in texts are plain text."""
    if (path, plain) not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path, plain] = Tokenizer.from_file(path)
        _tokenizers[path, plain].encode_special_tokens = plain
    return _tokenizers[path, plain]


def _ids(texts: list[str], path: str, plain: bool) -> list[bytes]:
    out = tokenizer(path, plain).encode_batch_fast(texts, add_special_tokens=False)
    return [np.asarray(x.ids, dtype="<u4").tobytes() for x in out]


def _joiner(path: str, plain: bool) -> tuple | None:
    """The tokenizer without its cut into pieces, and a byte that texts cut here don't hold and no merge does, with its id.

    None where there is no such byte, or where more than merges decides on the ids of a piece.
    """
    if (path, plain) not in _joiners:
        from tokenizers import Tokenizer, models

        own = tokenizer(path, plain)
        model, vocabulary = own.model, own.get_vocab(False)
        merged = set().union(*(t for t in vocabulary if len(t) > 1))
        free = [b for b in (*range(9), *range(14, 32)) if _BYTES[b] not in merged and _BYTES[b] in vocabulary]
        simple = isinstance(model, models.BPE) and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges)
        _joiners[path, plain] = (Tokenizer(model), chr(free[0]), vocabulary[_BYTES[free[0]]]) if free and simple and own.normalizer is None else None
    return _joiners[path, plain]


def _piece_ids(pieces: list[str], path: str, plain: bool) -> list[bytes]:
    """Ids of pieces, many encoded as one string: no merge crosses the byte between them."""
    joiner = _joiner(path, plain)
    if not joiner or not pieces:
        return _ids(pieces, path, plain)
    whole, between, id = joiner
    lines = (between.join([*pieces[at : at + JOINED], ""]).encode() for at in range(0, len(pieces), JOINED))
    found = whole.encode_batch_fast([codecs.charmap_decode(x, "strict", _BYTES)[0] for x in lines], add_special_tokens=False)
    ids = np.concatenate([np.asarray(x.ids, dtype="<u4") for x in found])
    ends = 4 * np.flatnonzero(ids == id)
    data = ids.tobytes()
    return [data[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]


def token_bytes(texts: list[str], path: str, plain: bool = False) -> list[bytes]:
    """Little-endian 32-bit ids of each text, as the tokenizer gives them for the whole text.

    A byte-level tokenizer of this kind merges within pieces only: runs of letters, of digits or
    of other signs, with a space before them, and runs of blanks.  For texts in Latin-1 letters
    these are found here, and the ids of pieces that come again are kept.  Texts with other
    characters, or that may hold a special token, are encoded whole.
    """
    known, seen = _pieces.setdefault((path, plain), ({}, np.zeros(SEEN, bool)))
    if len(known) > CACHED_PIECES:  # those met twice first are the most frequent
        for p in list(islice(known, CACHED_PIECES // 2, None)):
            del known[p]
        seen[:] = False
    whole = [i for i, t in enumerate(texts) if _OTHER.search(t) or "<|" in t]
    out = dict(zip(whole, _ids([texts[i] for i in whole], path, plain)))
    cut: dict[int, tuple[list, list[int], list[str]]] = {}  # ids by piece, the places of those that aren't kept, and these
    for i, t in enumerate(texts):
        if i not in out:
            pieces = _PIECE.findall(t)
            ids = list(map(known.get, pieces))
            gaps = [k for k, x in enumerate(ids) if x is None]
            cut[i] = ids, gaps, [pieces[k] for k in gaps]
    new = list(set().union(*(gone for _, _, gone in cut.values())))
    fresh = dict(zip(new, _piece_ids(new, path, plain)))
    for i, (ids, gaps, gone) in cut.items():
        for k, p in zip(gaps, gone):
            ids[k] = fresh[p]
        out[i] = b"".join(ids)
    slots = np.fromiter(map(hash, new), np.int64, len(new)) % SEEN
    known.update((p, fresh[p]) for p in compress(new, seen[slots].tolist()))  # most different pieces never come again
    seen[slots] = True
    return [out[i] for i in range(len(texts))]


def piece_table(docs: DataFrame, tokenizer: str, capacity: int, end: int, id: str, text: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut where longer."""
    cap = capacity * 4
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows: list[tuple] = []
                for i, ids in enumerate(token_bytes([x or "" for x in part.column("_fg_text").to_pylist()], tokenizer)):
                    ids += tail
                    first = len(ids) % cap or cap
                    cuts = [0, *range(first, len(ids), cap), len(ids)]
                    rows += [(i, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]), ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                own, piece, start, length, crc, data = zip(*rows)
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                columns = [part.column("doc_id").take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    names, columns = [*names, "ids"], [*columns, pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("_fg_text")).mapInArrow(run, schema)


def _fit(counts: np.ndarray, room: int) -> int:
    """The largest length present that fits into ``room``, or 0."""
    have = np.flatnonzero(counts[1 : room + 1])
    return int(have[-1]) + 1 if len(have) else 0


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sequences that dominate every other choice for a piece; takes them off ``counts``.

    A piece w goes alone if nothing fits beside it; with the piece that fills its sequence
    exactly, if there is one; with the largest that fits, if no two pieces fit beside w together.
    Each of these can be exchanged into any packing without using more sequences.  Taking pieces
    off never breaks the condition, so all pieces of a length are handled at once.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for w in range(capacity, 0, -1):
        while n := int(counts[w]):
            room = capacity - w
            others = counts.copy()
            others[w] -= 1
            best = _fit(others, room)
            if not best:
                fixed.append(((w,), n))
                counts[w] = 0
                break
            low = np.repeat(np.flatnonzero(others[: room + 1]), 2)[:4]
            low = [x for x, k in zip(low, (1, 2, 1, 2)) if others[x] >= k][:2]
            if best != room and len(low) == 2 and sum(low) <= room:
                break
            m = n // 2 if best == w else min(n, int(counts[best]))
            fixed.append(((w, best), m))
            counts[w] -= m
            counts[best] -= m
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: every piece, largest first, goes to the open sequence with the least room that holds it.

    Sequences of the same content are one group.  The tightest sequence stays the tightest as
    long as another piece of the length fits, so a whole group takes pieces at once.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> (lengths, sequences)
    rooms: list[int] = []  # those in use, rising

    def put(made: tuple[int, ...], room: int, times: int) -> None:
        if times:
            if not open_.get(room):
                open_[room] = []
                insort(rooms, room)
            open_[room].append((made, times))

    for w in range(capacity, 0, -1):
        n = int(counts[w])
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put((w,) * each, capacity - each * w, n // each)
                if n % each:
                    put((w,) * (n % each), capacity - n % each * w, 1)
                n = 0
                continue
            room = rooms[at]
            made, times = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = room // w
            full = min(times, n // each)
            put((*made, *(w,) * each), room - each * w, full)
            n -= full * each
            if full < times:
                rest = min(n, each - 1) if n < each else 0
                if rest:
                    put((*made, *(w,) * rest), room - rest * w, 1)
                n -= rest
                put(made, room, times - full - bool(rest))
        counts[w] = 0
    return [group for room in rooms for group in open_[room]]


def plan_packing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, how many sequences) for ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, ranks per sequence and first offset of each run of pieces."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for w in dict.fromkeys(lengths):
            each = lengths.count(w)
            out.setdefault(w, []).append((used.get(w, 0), sequence, each, offset))
            used[w] = used.get(w, 0) + each * times
            offset += each * w
        sequence += times
    return {w: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for w, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each goes.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, the piece's
    little-endian 32-bit ids, if ``with_ids``).  Null texts are empty and give the end id alone;
    repeated rows are packed as often as they come; an empty table gives an empty one.  Tokens
    are cut once and written to the shared folder.  The histogram (``capacity`` numbers) is all
    that reaches the driver, and the plan sent back is bounded by the capacity too.
    """
    pieces = materialise(piece_table(docs, tokenizer, capacity, end, id, text, with_ids), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    places = _places(plan_packing(counts, capacity))
    shares = F.element_at(F.lit([max(1, min(-(-int(n) // BUCKET), MANY), -(-int(n) // LARGE)) for n in counts]), (F.col("length") + 1).cast("int"))
    keyed = pieces.withColumn("_fg_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shares))
    sums = keyed.groupBy("length", "_fg_bucket").agg(F.count("*").alias("_fg_n"))
    before = W.partitionBy("length").orderBy("_fg_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("length", "_fg_bucket", F.coalesce(F.sum("_fg_n").over(before), F.lit(0)).alias("_fg_before"))
    in_bucket = W.partitionBy("length", "_fg_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_fg_rank", F.row_number().over(in_bucket) - 1)
    ranked = ranked.join(starts, ["length", "_fg_bucket"])  # both are dealt by these already
    ranked = ranked.withColumn("_fg_rank", F.col("_fg_rank") + F.col("_fg_before")).drop("_fg_bucket", "_fg_before")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_fg_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                own = order[a:b]
                w = int(length[own[0]])
                first, seq, each, off = places[w]
                run = np.searchsorted(first, rank[own], side="right") - 1
                step = rank[own] - first[run]
                sequence[own] = seq[run] + step // each[run]
                offset[own] = off[run] + step % each[run] * w
            columns = {n: batch.column(n) for n in names}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "_fg_rank").mapInArrow(put, f"{fields}, sequence_id long, offset long")
