"""Corpus-wide values for what documents hold, fetched once a chunk instead of once a document.

Documents are written in chunks of bounded size.  A chunk asks for each of its different keys
once; answers come from a join on the key and go to the chunk's documents, so what is shuffled
follows the different keys of a chunk and not the length of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Numbering:
    """Chunk numbers of a task: a new one when so much has been put into the last."""

    def __init__(self, most: int):
        self.most, self.held, self.number = most, 0, TaskContext.get().partitionId() << 32

    def of(self, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for k, size in enumerate(np.asarray(sizes).tolist()):
            if self.held and self.held + size > self.most:
                self.number, self.held = self.number + 1, 0
            self.held += size
            out[k] = self.number
        return out


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows of it): batches cut where the chunk changes and into at most ``rows`` rows."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, rows):
                yield int(chunk[at]), batch.slice(at, min(rows, b - at))


#: Rows of answers that a task holds before it packs them by chunk.
PACKED = 1 << 20


def packed(answers: DataFrame) -> DataFrame:
    """(chunk, block array<binary>): the rows that a task has for a chunk, column by column; binaries as lengths and bytes."""
    names = [c for c in answers.columns if c != "chunk"]

    def blocks(table: pa.Table) -> pa.RecordBatch:
        chunk = table.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        table, chunk = table.take(pa.array(order)).combine_chunks(), chunk[order]
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            block = []
            for name in names:
                part = table.column(name).chunk(0).slice(a, b - a)
                if pa.types.is_binary(part.type):
                    ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
                    block += [np.diff(ends).tobytes(), bytes(part.buffers()[2][ends[0] : ends[-1]]) if part.buffers()[2] else b""]
                else:
                    block.append(part.to_numpy(zero_copy_only=False).tobytes())
            out.append(block)
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array(out, pa.list_(pa.binary()))], names=["chunk", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACKED:
                yield blocks(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield blocks(pa.Table.from_batches(held))

    return answers.select("chunk", *names).mapInArrow(run, "chunk long, block array<binary>")


def unpacked(blocks: list[list[bytes]], kinds: list[str]) -> list:
    """The columns of packed rows: arrays, and for binaries lists of bytes."""
    out, at = [], 0
    for kind in kinds:
        whole = b"".join(b[at] for b in blocks)
        if kind == "binary":
            data = b"".join(b[at + 1] for b in blocks)
            ends = np.cumsum(np.frombuffer(whole, np.int32), dtype=np.int64).tolist()
            out.append([data[a:b] for a, b in zip([0, *ends[:-1]], ends)] if ends else [])
            at += 2
        else:
            out.append(np.frombuffer(whole, {"bigint": np.int64, "double": np.float64, "boolean": bool}[kind]))
            at += 1
    return out


def answered(held: DataFrame, asked: list[DataFrame], prepare: Callable, kernel: Callable, schema: str, rows: int = 256) -> DataFrame:
    """``kernel(tables, rows)`` on the documents of each chunk.

    ``held`` is (chunk, ...) and each of ``asked`` (chunk, ...), the answers for the chunk's keys,
    of longs, doubles, booleans and binaries.  ``prepare(columns, ...)`` makes a chunk's tables
    from the columns of each of ``asked``; ``kernel`` gets them with record batches of ``held`` and
    yields record batches.  A chunk's answers come before its documents, which pass one after the other.
    """
    last = len(asked)
    kinds = [[t for c, t in a.dtypes if c != "chunk"] for a in asked]
    both = held.select("chunk", F.lit(last).alias("part"), F.struct(*[c for c in held.columns if c != "chunk"]).alias("own"))
    for i, a in enumerate(asked):
        both = both.unionByName(packed(a).withColumn("part", F.lit(i)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, blocks, tables = None, None, None
        for batch in batches:
            number, part = batch.column("chunk").to_numpy(), batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(part) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if number[a] != chunk:
                    chunk, blocks, tables = number[a], [[] for _ in range(last)], None
                if part[a] < last:
                    blocks[part[a]] += batch.column("block").slice(a, b - a).to_pylist()
                    continue
                if tables is None:
                    tables = prepare(*(unpacked(x, k) for x, k in zip(blocks, kinds)))
                    blocks = [[] for _ in range(last)]
                for at in range(a, b, rows):
                    yield from kernel(tables, pa.RecordBatch.from_struct_array(batch.column("own").slice(at, min(rows, b - at))))

    return both.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, schema)
