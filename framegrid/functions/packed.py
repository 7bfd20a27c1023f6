"""Numpy kernels on frames packed as binary columns, (clip_id, frame_idx, h, w, rgb, a): three bytes a pixel, one for alpha."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of red, green and blue in luma, and the scales of the two chroma differences.
LUMA, CB_SCALE, CR_SCALE = np.array([0.299, 0.587, 0.114]), 0.564, 0.713


def chroma(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cb and Cr of pixels, unrounded."""
    y = rgb @ LUMA
    return (rgb[..., 2] - y) * CB_SCALE + 128, (rgb[..., 0] - y) * CR_SCALE + 128


def distance_from(rgb: np.ndarray, model: dict) -> np.ndarray:
    """Chroma distance of pixels from a backdrop, in its own deviations."""
    u, v = chroma(rgb)
    return np.hypot((u - model["mu_u"]) / model["sd_u"], (v - model["mu_v"]) / model["sd_v"])


def ellipse(r: int) -> list[tuple[int, int]]:
    """(dy, half width) of the rows of an elliptical structuring element of side 2r + 1."""
    return [(dy, int(np.rint(np.sqrt(r * r - dy * dy)))) for dy in range(-r, r + 1)]


def disc(radius: float) -> list[tuple[int, int]]:
    """(dy, half width) of all places within ``radius``."""
    r = int(radius)
    return [(dy, int(np.sqrt(radius * radius - dy * dy))) for dy in range(-r, r + 1)]


def square(r: int) -> list[tuple[int, int]]:
    return [(dy, r) for dy in range(-r, r + 1)]


def spread(m: np.ndarray, rows: list[tuple[int, int]]) -> np.ndarray:
    """Dilation of a mask by an element given as rows, alike above and below; places outside the frame are ignored.

    A row's reach is a difference of running sums, so the cost grows with the element's height only.
    """
    h, w = m.shape
    most = max(half for _, half in rows)
    total = np.zeros((h, w + 1 + 2 * most), np.int32)
    np.cumsum(m, axis=1, out=total[:, most + 1 : most + 1 + w])
    total[:, most + 1 + w :] = total[:, most + w : most + w + 1]
    out = np.zeros((h, w), bool)
    for dy, half in rows:
        if 0 <= dy < h:
            wide = total[:, most + half + 1 : most + half + 1 + w] > total[:, most - half : most - half + w]
            out[: h - dy] |= wide[dy:]
            out[dy:] |= wide[: h - dy]
    return out


def shrink(m: np.ndarray, rows: list[tuple[int, int]]) -> np.ndarray:
    return ~spread(~m, rows)


def map_packed(frames: DataFrame, kernel: Callable[..., dict], fields: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(clip_id, frame_idx, fields): ``kernel(rgb, a, extra columns...)`` on every frame where it is; arrays come back as bytes."""
    names = [f.split()[0] for f in fields.split(", ")]
    kept = ["clip_id", "frame_idx", "h", "w", "rgb", "a", *extra]
    clip = frames.schema["clip_id"].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                others = [part.column(c).to_pylist() for c in extra]
                for k in range(part.num_rows):
                    h, w = (part.column(c)[k].as_py() for c in ("h", "w"))
                    rgb = np.frombuffer(part.column("rgb")[k].as_buffer(), np.uint8).reshape(h, w, 3)
                    a = np.frombuffer(part.column("a")[k].as_buffer(), np.uint8).reshape(h, w) if part.column("a")[k].is_valid else None
                    out.append(kernel(rgb, a, *(o[k] for o in others)))
                columns = [pa.array([r[n].tobytes() if isinstance(r[n], np.ndarray) and f.split()[1] == "binary" else r[n] for r in out], _KINDS[f.split()[1]]) for n, f in zip(names, fields.split(", "))]
                yield pa.RecordBatch.from_arrays([part.column("clip_id"), part.column("frame_idx"), *columns], names=["clip_id", "frame_idx", *names])

    return frames.select(*kept).mapInArrow(run, f"clip_id {clip}, frame_idx int, {fields}")


#: Pixels of small frames that go out at once in the long form.
PIXELS = 1 << 15
#: Frames of a clip that a task takes in order with the neighbours that they need.
SEGMENT = 64

_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def segment(frame: str = "frame_idx") -> Column:
    """The number of a frame's stretch of SEGMENT frames."""
    return F.floor(F.col(frame) / SEGMENT).cast("int")


def map_window(frames: DataFrame, before: int, after: int, kernel: Callable[..., dict], fields: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(clip_id, frame_idx, fields): ``kernel(window)`` on every frame with its neighbours.

    ``window`` has one entry per frame from ``before`` ones before to ``after`` ones after: None
    where the clip has no such frame, else a dictionary of rgb, a and the extra columns.  A clip
    is cut into stretches that share only their neighbours at the ends, so that few frames travel
    twice and a long clip is many tasks; a task holds the frames of one window.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kept = ["clip_id", "frame_idx", "h", "w", "rgb", "a", *extra]
    clip = frames.schema["clip_id"].dataType.simpleString()
    first, last = (F.floor((F.col("frame_idx") + k) / SEGMENT).cast("int") for k in (-after, before))
    dealt = frames.select(*kept).withColumn("_part", F.explode(F.sequence(first, last)))
    dealt = dealt.repartition("clip_id", "_part").sortWithinPartitions("clip_id", "_part", "frame_idx")

    def read(batch: pa.RecordBatch, k: int) -> dict:
        h, w = (batch.column(c)[k].as_py() for c in ("h", "w"))
        out = {c: batch.column(c)[k].as_py() for c in extra}
        out["rgb"] = np.frombuffer(batch.column("rgb")[k].as_py(), np.uint8).reshape(h, w, 3)
        out["a"] = np.frombuffer(batch.column("a")[k].as_py(), np.uint8).reshape(h, w) if batch.column("a")[k].is_valid else None
        return out

    def write(clip_id, made: list[tuple[int, dict]], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([r[n].tobytes() if isinstance(r[n], np.ndarray) and f.split()[1] == "binary" else r[n] for _, r in made], _KINDS[f.split()[1]]) for n, f in zip(names, fields.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array([clip_id] * len(made), kind), pa.array([i for i, _ in made], pa.int32()), *columns], names=["clip_id", "frame_idx", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting, kind = None, {}, [], None

        def done(upto: int | None) -> list[tuple[int, dict]]:
            out = []
            while waiting and (upto is None or waiting[0] + after <= upto):
                i = waiting.pop(0)
                out.append((i, kernel([held.get(i + k) for k in range(-before, after + 1)])))
            low = (waiting[0] if waiting else upto + 1 if upto is not None else 0) - before
            for i in [i for i in held if i < low]:
                del held[i]
            return out

        for batch in batches:
            kind = batch.schema.field("clip_id").type
            for k in range(batch.num_rows):
                own = (batch.column("clip_id")[k].as_py(), batch.column("_part")[k].as_py())
                if own != at:
                    if at is not None and (made := done(None)):
                        yield write(at[0], made, kind)
                    at, held, waiting = own, {}, []
                i = batch.column("frame_idx")[k].as_py()
                held[i] = read(batch, k)
                if i // SEGMENT == own[1]:
                    waiting.append(i)
                if made := done(i):
                    yield write(own[0], made, kind)
        if at is not None and (made := done(None)):
            yield write(at[0], made, kind)

    return dealt.mapInArrow(run, f"clip_id {clip}, frame_idx int, {fields}")


def with_clip(frames: DataFrame, side: DataFrame) -> DataFrame:
    """``frames`` joined with ``side`` (one row per clip): the row is copied to the clip's stretches, so no clip is one task."""
    held = frames.withColumn("_part", segment())
    parts = held.select("clip_id", "_part").distinct().join(side, "clip_id")
    return held.join(parts, ["clip_id", "_part"]).drop("_part")


def unpack(frames: DataFrame, columns: dict[str, int], w: int = 0) -> DataFrame:
    """The long form of byte columns: one row per pixel with y, x and ``columns`` (name -> bytes a pixel; three give r, g, b)."""
    names = [n for c, k in columns.items() for n in ([c] if k == 1 else ["r", "g", "b"])]
    clip = frames.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pixels = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                width = batch.column("w")[k].as_py()
                n = width * batch.column("h")[k].as_py()
                layers = []
                for c, size in columns.items():
                    x = np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8).reshape(n, size)
                    layers += [pa.array(x[:, j].astype(np.int32)) for j in range(size)]
                p = np.arange(n, dtype=np.int32)
                own = [pa.array([batch.column(c)[k].as_py()] * n, batch.schema.field(c).type) for c in ("clip_id", "frame_idx")]
                held.append(pa.RecordBatch.from_arrays([*own, pa.array(p // width), pa.array(p % width), *layers], names=["clip_id", "frame_idx", "y", "x", *names]))
                pixels += n
                if pixels >= PIXELS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, pixels = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return frames.select("clip_id", "frame_idx", "h", "w", *columns).mapInArrow(run, f"clip_id {clip}, frame_idx int, y int, x int, " + ", ".join(f"{n} int" for n in names))
