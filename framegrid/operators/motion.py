"""Operators along motion: chatter, steadying, holes, limbs, and pixels that stand still.

Motion is dense optical flow between the grey frames of a clip; frames meet their neighbours in
short stretches of the clip, and what is known of a clip as a whole is one plane of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.functions import flow as W
from framegrid.functions import kernels as K
from framegrid.functions import packed as P
from framegrid.functions.flow import flow_between
from framegrid.functions.resample import gaussian
from framegrid.operators.folds import clip_fold
from framegrid.operators.quality import OPAQUE, roll_up

FRAME = "h int, w int, rgb binary, a binary"
#: Fixed: deviation of the blur of differences, and the level of change below which a pixel stands still.
BLUR, STILL = 3.0, 12.0


def _frame(rgb: np.ndarray, a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "rgb": rgb, "a": a}


def chatter_frames(frames: DataFrame, **search) -> DataFrame:
    """(clip_id, frame_idx, n): pixels whose mask differs from where they are in the next frame."""

    def run(window: list) -> dict:
        here, then = window
        if then is None:
            return {"n": None}
        along = flow_between(W.grey(here["rgb"]), W.grey(then["rgb"]), **search)
        return {"n": int(((here["a"] > OPAQUE) != W.warp(then["a"] > OPAQUE, along, nearest=True)).sum())}

    return P.map_window(frames, 0, 1, run, "n long").where("n is not null")


def chatter(frames: DataFrame, **search) -> DataFrame:
    """(clip_id, total, worst_frame, worst_value, mean) of ``chatter_frames``."""
    return roll_up(chatter_frames(frames, **search))


def steadied(frames: DataFrame, half: int = 1, scale: float = 1.0, **search) -> DataFrame:
    """Alpha as the median of a frame's own and those of ``half`` frames on either side, each brought to it along the flow.

    Frames with fewer neighbours, as at the ends, stay; ``half`` of 0 changes nothing.
    """
    if half < 0:
        raise ValueError(f"{half} frames on either side")

    def run(window: list) -> dict:
        own = window[half]
        if half == 0 or any(f is None for f in window):
            return _frame(own["rgb"], own["a"])
        here, layers = W.grey(own["rgb"]), [own["a"].astype(np.float64)]
        for f in window[:half] + window[half + 1 :]:
            layers.append(np.rint(W.warp(f["a"], flow_between(here, W.grey(f["rgb"]), scale, **search))))
        return _frame(own["rgb"], np.median(np.stack(layers), axis=0).astype(np.uint8))

    return P.map_window(frames, half, half, run, FRAME)


def topology_over_time(frames: DataFrame, share: float, **search) -> DataFrame:
    """Components of less than ``share`` of the frame go; a hole is filled only where the frame before, brought along the flow, was opaque, with its alpha."""

    def run(window: list) -> dict:
        old, own = window
        a = own["a"]
        label = K.components(a > OPAQUE)
        ids, areas = np.unique(label[label >= 0], return_counts=True)
        kept = np.where(np.isin(label, ids[areas >= share * a.size]), a, 0)
        hole = K.holes(kept > OPAQUE)
        if old is None:
            return _frame(own["rgb"], np.where(hole, 255, kept).astype(np.uint8))
        before = np.rint(W.warp(old["a"], flow_between(W.grey(own["rgb"]), W.grey(old["rgb"]), **search)))
        return _frame(own["rgb"], np.where(hole & (before > OPAQUE), np.maximum(before, kept), kept).astype(np.uint8))

    return P.map_window(frames, 1, 0, run, FRAME)


def limbs_restored(frames: DataFrame, tau: float = 1.5, grow: int = 3, **search) -> DataFrame:
    """Alpha within ``region`` (a mask column), and beyond it where it moves and hangs on the body that is kept.

    Motion is flow from the frame before of more than ``tau`` pixels, grown by ``grow``; a clip's
    first frame has none.  Components are by four neighbours.
    """

    def run(window: list) -> dict:
        old, own = window
        a = own["a"]
        inside = np.frombuffer(own["region"], np.uint8).reshape(a.shape) > OPAQUE
        gated, on = np.where(inside, a, 0).astype(np.uint8), a > OPAQUE
        if old is None or not (on & ~inside).any() or not (on & inside).any():
            return _frame(own["rgb"], gated)
        moved = np.hypot(*np.moveaxis(flow_between(W.grey(own["rgb"]), W.grey(old["rgb"]), **search), 2, 0)) > tau
        label = K.components(on, K.FOUR)
        add = on & ~inside & np.isin(label, np.unique(label[on & inside])) & P.spread(moved, P.ellipse(grow))
        return _frame(own["rgb"], np.where(add, a, gated))

    return P.map_window(frames, 1, 0, run, FRAME, ("region",))


def motion_maps(frames: DataFrame, sigma: float = BLUR) -> DataFrame:
    """(clip_id, h, w, motion array<double> as bytes): by pixel the greatest blurred change of any channel between two frames; null for clips of one frame."""

    def change(window: list) -> dict:
        old, own = window
        if old is None:
            return {"d": None}
        return {"d": gaussian(np.abs(own["rgb"].astype(np.int64) - old["rgb"]).max(axis=2), sigma)}

    sizes = frames.groupBy("clip_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    steps = P.map_window(frames, 1, 0, change, "d binary").where("d is not null")
    most = clip_fold(steps, ("d",), lambda d: [d.view(np.float64)], lambda s, t: [np.maximum(s[0], t[0])])
    return sizes.join(most.select("clip_id", F.col("state")[0].alias("motion")), "clip_id", "left")


def _levels_of_still(frames: DataFrame, channels: tuple[int, ...]) -> DataFrame:
    """(clip_id, channel, place, level, n): how often pixels that stand still have each level; channel 3 is alpha.

    Still pixels have few levels; they are counted in the task before they are handed on.
    """
    clip = frames.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (clip_id, channel), parts in held.items():
                keys, n = (np.concatenate(x) for x in zip(*parts))
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, n).astype(np.int64)
                own = [pa.array([clip_id] * len(keys), kind), pa.array(np.full(len(keys), channel, np.int32))]
                yield pa.RecordBatch.from_arrays([*own, pa.array((keys // 256).astype(np.int32)), pa.array((keys % 256).astype(np.int32)), pa.array(n)], names=["clip_id", "channel", "place", "level", "n"])
            held.clear()

        count, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("clip_id").type
            for k in range(batch.num_rows):
                still = np.flatnonzero(np.frombuffer(batch.column("still")[k].as_py(), np.uint8))
                rgb, a = (np.frombuffer(batch.column(c)[k].as_py(), np.uint8) for c in ("rgb", "a"))
                for c in channels:
                    level = a[still] if c == 3 else rgb[3 * still + c]
                    keys = still * 256 + level
                    held.setdefault((batch.column("clip_id")[k].as_py(), c), []).append((keys, np.ones(len(keys), np.int64)))
                    count += len(keys)
                if count > 1 << 22:
                    yield from out()
                    count = 0
        yield from out()

    return frames.select("clip_id", "rgb", "a", "still").mapInArrow(run, f"clip_id {clip}, channel int, place int, level int, n long")


def still_planes(frames: DataFrame, motion: DataFrame, below: float = STILL, colours: bool = False) -> DataFrame:
    """(clip_id, still binary, frozen binary[, frozen_rgb]): pixels whose motion stays below ``below``, and the median over time of their alpha (and colours).

    Medians come from counted levels, so no clip is gathered; between two middle levels the mean is cut to a whole number.
    """
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [(np.frombuffer(m, np.float64) < below).astype(np.uint8).tobytes() for m in batch.column("motion").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(planes, pa.binary())], names=["clip_id", "still"])

    clip = frames.schema["clip_id"].dataType.simpleString()
    still = motion.where("motion is not null").select("clip_id", "motion").mapInArrow(mask, f"clip_id {clip}, still binary")
    channels = (0, 1, 2, 3) if colours else (3,)
    counted = _levels_of_still(P.with_clip(frames.select("clip_id", "frame_idx", "rgb", "a"), still), channels)
    counted = counted.groupBy("clip_id", "channel", "place", "level").agg(F.sum("n").alias("n"))
    levels = counted.groupBy("clip_id", "channel", "place").agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("l"), F.sum("n").alias("m"))  # at most 256 of them
    runs = levels.select("clip_id", "channel", "place", "m", F.col("l.level").alias("at"), F.aggregate("l", F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x["n"]))).alias("upto"))
    middle = lambda k: F.element_at("at", F.array_position(F.transform("upto", lambda u: u >= k), True).cast("int"))
    low, high = middle(F.floor((F.col("m") + 1) / 2)), middle(F.floor(F.col("m") / 2) + 1)
    medians = runs.select("clip_id", "channel", "place", F.floor((low + high) / 2).cast("int").alias("level"))
    points = medians.groupBy("clip_id").agg(F.collect_list(F.struct("channel", "place", "level")).alias("points"))  # one plane

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                mask = batch.column("still")[k].as_py()
                plane = np.zeros((4, len(mask)), np.uint8)
                points = batch.column("points")[k].values if batch.column("points")[k].is_valid else []
                if len(points):
                    c, p, v = (points.field(n).to_numpy() for n in ("channel", "place", "level"))
                    plane[c, p] = v
                out.append((mask, plane[3].tobytes(), np.ascontiguousarray(plane[:3].T).tobytes() if colours else None))
            columns = [pa.array([r[j] for r in out], pa.binary()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), *columns], names=["clip_id", "still", "frozen", "frozen_rgb"])

    return still.join(points, "clip_id", "left").mapInArrow(planes, f"clip_id {clip}, still binary, frozen binary, frozen_rgb binary")


def frozen_still(frames: DataFrame, planes: DataFrame) -> DataFrame:
    """``frames`` with the alpha, and the colours where the planes have them, of pixels that stand still held at their median; clips without a plane stay."""
    missing = frames.select("clip_id").distinct().join(planes, "clip_id", "left")

    def run(rgb: np.ndarray, a: np.ndarray, still: bytes | None, frozen: bytes | None, colours: bytes | None) -> dict:
        if still is None:
            return _frame(rgb, a)
        m = np.frombuffer(still, np.uint8).reshape(a.shape) > 0
        out = np.where(m, np.frombuffer(frozen, np.uint8).reshape(a.shape), a)
        if colours is not None:
            rgb = np.where(m[..., None], np.frombuffer(colours, np.uint8).reshape(rgb.shape), rgb)
        return _frame(rgb, out)

    return P.map_packed(P.with_clip(frames, missing), run, FRAME, ("still", "frozen", "frozen_rgb"))


def smoothed_over_time(frames: DataFrame, half: int = 1, below: float | None = STILL, colours: bool = False, sigma: float = BLUR, scale: float = 1.0, **search) -> DataFrame:
    """Alpha steadied along the flow, then pixels that stand still held at the median over time of the alpha as it was.

    ``below`` of None leaves out the second step, ``colours`` holds colours too.  Clips of fewer
    than three frames, or ``half`` of 0, stay as they are.
    """
    if half <= 0:
        return frames.select("clip_id", "frame_idx", "h", "w", "rgb", "a")
    out = steadied(frames, half, scale, **search)
    if below is None:
        return out
    long = frames.groupBy("clip_id").agg(F.count("*").alias("_n")).where("_n >= 3").select("clip_id")
    motion = motion_maps(frames, sigma).join(long, "clip_id", "left_semi")
    return frozen_still(out, still_planes(frames, motion, below, colours))
