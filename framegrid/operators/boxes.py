"""Boxes of a clip's subject by frame: as found, one for the clip, or smoothed; and boxes for frames to be matted again.

A frame's box is x0, y0, x1, y1, all null where nothing was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.operators.folds import fold
from framegrid.operators.temporal import fill_gaps, regions, rolling_median

BOX = ("x0", "y0", "x1", "y1")
MODES = ("per_frame", "clip_union", "smoothed")


def union(keys: list[str], boxes: DataFrame) -> DataFrame:
    """(keys, x0, y0, x1, y1): the box around all boxes of the keys; null if there are none."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def smoothed(boxes: DataFrame, half: int = 7, hold: int = 5) -> DataFrame:
    """Centres and sizes as medians of ``half`` frames on either side, gaps filled; a box grows at once and shrinks after ``hold`` requests."""
    filled = boxes.select("clip_id", "frame_idx", F.when(F.col("x0").isNotNull(), F.struct(*BOX)).alias("b")).withColumn("b", fill_gaps("b"))
    shape = {"cx": (F.col("b.x0") + F.col("b.x1")) / 2, "cy": (F.col("b.y0") + F.col("b.y1")) / 2, "bw": F.col("b.x1") - F.col("b.x0"), "bh": F.col("b.y1") - F.col("b.y0")}
    medians = filled.withColumns(shape).select("clip_id", "frame_idx", *(rolling_median(c, half).alias(c) for c in shape))

    def step(state, row):
        cx, cy, w, h = row
        if cx is None:
            return state, (None,) * 4
        if state is None or w * h >= state[0] * state[1] or state[2] + 1 >= hold:
            state = (w, h, 0)
        else:
            state = (state[0], state[1], state[2] + 1)
        return state, (cx - state[0] / 2, cy - state[1] / 2, cx + state[0] / 2, cy + state[1] / 2)

    return fold(medians, ["clip_id"], ["frame_idx"], list(shape), step, "x0 double, y0 double, x1 double, y1 double")


def resolved(boxes: DataFrame, mode: str) -> DataFrame:
    """(clip_id, frame_idx, x0, y0, x1, y1): every frame's box in one of the modes; another mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown box mode: {mode!r}")
    if mode == "smoothed":
        return smoothed(boxes)
    if mode == "clip_union":
        return boxes.select("clip_id", "frame_idx").join(union(["clip_id"], boxes), "clip_id").select("clip_id", "frame_idx", *BOX)
    return boxes.select("clip_id", "frame_idx", *BOX)


def grown(w: Column, h: Column, share: float = 0.5) -> list[Column]:
    """The box larger by ``share`` about its centre, cut to the frame."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    bw, bh = (F.col("x1") - F.col("x0")) * (1 + share) / 2, (F.col("y1") - F.col("y0")) * (1 + share) / 2
    least, most = lambda v: F.greatest(F.lit(0.0), v), lambda v, end: F.least(end.cast("double"), v)
    return [F.when(F.col("x0").isNotNull(), v).alias(n) for n, v in zip(BOX, (least(cx - bw), least(cy - bh), most(cx + bw, w), most(cy + bh, h)))]


def repairs(boxes: DataFrame, w: Column, h: Column, merge: int = 3, share: float = 0.5) -> DataFrame:
    """(clip_id, frame_idx, first, last, x0, y0, x1, y1) of the frames to matte again.

    ``boxes`` has ``truncated``, whether the subject was cut off.  Runs of such frames, gaps of up
    to ``merge`` frames bridged, are done again whole, in a grown box around all of the run's
    boxes; null is the full frame.
    """
    runs = regions(boxes, F.col("truncated"), merge)
    every = runs.withColumn("frame_idx", F.explode(F.sequence("first", "last")))
    own = boxes.join(every, ["clip_id", "frame_idx"])
    around = union(["clip_id", "first"], own).select("clip_id", "first", *grown(w, h, share))
    return own.select("clip_id", "frame_idx", "first", "last").join(around, ["clip_id", "first"]).select("clip_id", "frame_idx", "first", "last", *BOX)


def full_frame_where(again: DataFrame, touches: Column) -> DataFrame:
    """``again`` with the full frame where the alpha in the grown box touches its edge once more."""
    return again.select("clip_id", "frame_idx", "first", "last", *(F.when(~touches, F.col(c)).alias(c) for c in BOX))


def salient(x: Column, y: Column, on: Column, w: Column, h: Column, share: float = 0.12) -> list[Column]:
    """Aggregates of the box around the pixels where ``on`` holds, padded by ``share`` of its sides, within the frame; null where there are none."""
    at = lambda f, c: f(F.when(on, c))
    x0, y0, x1, y1 = at(F.min, x), at(F.min, y), at(F.max, x) + 1, at(F.max, y) + 1
    px, py = F.rint((x1 - x0) * share).cast("int"), F.rint((y1 - y0) * share).cast("int")
    sides = (F.greatest(F.lit(0), x0 - px), F.greatest(F.lit(0), y0 - py), F.least(w, x1 + px), F.least(h, y1 + py))
    return [F.when(F.max(on), v).alias(n) for n, v in zip(BOX, sides)]  # greatest and least skip nulls
