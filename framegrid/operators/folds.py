"""Ordered folds: rows of a key in order, with only the last state held, however long the key's run is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: States of at most so many clips are held in a task before they are handed on.
HELD = 16

_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable, fields: str) -> DataFrame:
    """(keys, order, fields): ``step(state, row)`` gives the next state and a tuple for ``fields``, or None for no row.

    ``row`` is a tuple of ``columns``; the state is None at a key's first row.  Rows are dealt by
    key and sorted on disk if need be, and one pass over them emits as it goes.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [_KINDS[f.split()[1]] for f in fields.split(", ")]
    kept = list(dict.fromkeys([*keys, *order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            rows = zip(*(batch.column(c).to_pylist() for c in columns))
            places, out = [], []
            for i, row in enumerate(rows):
                if own[i] != key:
                    key, state = own[i], None
                state, made = step(state, row)
                if made is not None:
                    places.append(i)
                    out.append(made)
            values = list(zip(*out)) if out else [()] * len(names)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *(pa.array(v, t) for v, t in zip(values, kinds))], names=[*kept, *names])

    dealt = df.select(*dict.fromkeys([*kept, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    form = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.mapInArrow(run, f"{form}, {fields}")


def clip_fold(frames: DataFrame, columns: tuple[str, ...], start: Callable[..., list[np.ndarray]], join: Callable[[list, list], list]) -> DataFrame:
    """(clip_id, state array<binary>): every clip's frames folded; ``start`` makes a frame's state, ``join`` merges two, in any order."""
    form = f"clip_id {frames.schema['clip_id'].dataType.simpleString()}, state array<binary>, kinds array<string>"

    def out(held: dict) -> pa.RecordBatch:
        states = [[x.tobytes() for x in s] for s in held.values()]
        kinds = [[x.dtype.str for x in s] for s in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa_clip), pa.array(states, pa.list_(pa.binary())), pa.array(kinds, pa.list_(pa.string()))], names=["clip_id", "state", "kinds"])

    pa_clip = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[frames.schema["clip_id"].dataType.simpleString()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                clip = batch.column("clip_id")[k].as_py()
                if "state" in batch.schema.names:
                    state = [np.frombuffer(b, t) for b, t in zip(batch.column("state")[k].as_py(), batch.column("kinds")[k].as_py())]
                else:
                    state = start(*(np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in columns))
                held[clip] = join(held[clip], state) if clip in held else state
                if len(held) > HELD:
                    first = next(iter(held))
                    yield out({first: held.pop(first)})
        if held:
            yield out(held)

    partial = frames.select("clip_id", *columns).mapInArrow(fold, form)
    return partial.repartition("clip_id").sortWithinPartitions("clip_id").mapInArrow(fold, form).select("clip_id", "state")
