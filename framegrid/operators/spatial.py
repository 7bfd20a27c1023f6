"""Neighbourhood operators on packed frames (numpy kernels) and on long pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.functions import kernels as K
from framegrid.functions.kernels import map_frames

OPAQUE = 127


def morphology(frames: DataFrame, how: str, r: int = 1) -> DataFrame:
    """(clip_id, frame_idx, data) with every pixel the greatest (dilate) or least (erode) around it."""
    f = {"dilate": K.dilate, "erode": K.erode, "median": K.median3}[how]
    return map_frames(frames, lambda a: {"data": f(a, r) if how != "median" else f(a)}, "data array<double>")


def component_table(frames: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, label, area, x0, y0, x1, y1) of the 8-connected opaque components; labels are first places."""

    def kernel(a: np.ndarray) -> dict:
        label = K.components(a > OPAQUE)
        ys, xs = np.nonzero(label >= 0)
        if not len(ys):
            return {"c": []}
        own = label[ys, xs]
        order = np.argsort(own, kind="stable")
        ids, first, n = np.unique(own[order], return_index=True, return_counts=True)
        low, high = ([f.reduceat(v[order], first) for v in (xs, ys)] for f in (np.minimum, np.maximum))
        return {"c": [dict(zip(("label", "area", "x0", "y0", "x1", "y1"), map(int, r))) for r in zip(ids, n, *low, *high)]}

    found = map_frames(frames, kernel, "c array<struct<label:int,area:int,x0:int,y0:int,x1:int,y1:int>>")
    return found.select("clip_id", "frame_idx", F.inline("c"))


def hole_pixels(frames: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, n): background that the border can't reach."""
    return map_frames(frames, lambda a: {"n": int(K.holes(a > OPAQUE).sum())}, "n long")


def trimap(frames: DataFrame, sure: int = 229, maybe: int = 25) -> DataFrame:
    """(clip_id, frame_idx, data): 1 inside the eroded sure part, 0 outside the dilated possible part, alpha between."""

    def kernel(a: np.ndarray) -> dict:
        fg, bg = K.erode(a > sure), ~K.dilate(a > maybe)
        return {"data": np.where(fg, 1.0, np.where(bg, 0.0, a / 255.0))}

    return map_frames(frames, kernel, "data array<double>")


def keep_subject(frames: DataFrame, share: float = 0.25) -> DataFrame:
    """(clip_id, frame_idx, data): components smaller than ``share`` of the largest are cleared, with rims around none kept."""

    def kernel(a: np.ndarray) -> dict:
        label = K.components(a > OPAQUE)
        ids, n = np.unique(label[label >= 0], return_counts=True)
        if not len(ids):
            return {"data": a}
        keep = np.isin(label, ids[n >= share * n.max()])
        drop = (label >= 0) & ~keep
        near = K.dilate(drop) & ~K.dilate(keep)
        return {"data": np.where(drop | near, 0, a)}

    return map_frames(frames, kernel, "data array<int>")


def edge_touch(pixels: DataFrame, boxes: DataFrame, level: int = OPAQUE) -> DataFrame:
    """(clip_id, frame_idx, touches): opaque pixels on an edge of the frame's box that isn't the frame's own edge.

    ``boxes`` has x0, y0, x1, y1 (ends exclusive) and the frame's w and h.
    """
    p = pixels.join(boxes, ["clip_id", "frame_idx"])
    inside = F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1)
    edge = ((F.col("x") == F.col("x0")) & (F.col("x0") > 0)) | ((F.col("x") == F.col("x1") - 1) & (F.col("x1") < F.col("w"))) | ((F.col("y") == F.col("y0")) & (F.col("y0") > 0)) | ((F.col("y") == F.col("y1") - 1) & (F.col("y1") < F.col("h")))
    return p.groupBy("clip_id", "frame_idx").agg(F.bool_or(inside & edge & (F.col("a") > level)).alias("touches"))


def track_links(pixels: DataFrame, components: DataFrame, gap: int = 3, share: float = 0.3) -> DataFrame:
    """(clip_id, f1, l1, f2, l2): components up to ``gap`` frames apart that share ``share`` of the smaller's area.

    ``pixels`` is (clip_id, frame_idx, label, place).  The band of frames is exploded, so that the
    join is on equal clip, frame and place.
    """
    a = pixels.select("clip_id", F.col("frame_idx").alias("f1"), F.col("label").alias("l1"), "place").withColumn("f2", F.explode(F.sequence(F.col("f1") + 1, F.col("f1") + gap)))
    b = pixels.select("clip_id", F.col("frame_idx").alias("f2"), F.col("label").alias("l2"), "place")
    both = a.join(b, ["clip_id", "f2", "place"]).groupBy("clip_id", "f1", "l1", "f2", "l2").agg(F.count("*").alias("shared"))
    area = lambda k: components.select("clip_id", F.col("frame_idx").alias(f"f{k}"), F.col("label").alias(f"l{k}"), F.col("area").alias(f"a{k}"))
    sized = both.join(area(1), ["clip_id", "f1", "l1"]).join(area(2), ["clip_id", "f2", "l2"])
    return sized.where(F.col("shared") >= share * F.least("a1", "a2")).select("clip_id", "f1", "l1", "f2", "l2", "shared")
