"""Mattes from crops around the subject's box: one pass, a look at the crop's edges, and passes anew where the crop cut something off."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.functions import closedform
from framegrid.functions import packed as P
from framegrid.functions.resample import bilinear, crop_to
from framegrid.operators import boxes as B

#: Fixed: share of a box's sides that is added on each, side of the model's input, and the level from which an edge is touched.
MARGIN, SIDE, TOUCH = 0.12, 1024, 0.5

Model = Callable[[np.ndarray], np.ndarray]
MATTE = "h int, w int, rgb binary, a binary, truncated boolean, passes int"


def crop_of(box: tuple | None, h: int, w: int, margin: float = MARGIN) -> tuple[int, int, int, int]:
    """(y0, y1, x0, x1) of the box, cut to whole pixels and wider by ``margin``, within the frame; all of it without a box."""
    if box is None:
        return 0, h, 0, w
    x0, y0, x1, y1 = (int(v) for v in box)
    mx, my = int((x1 - x0) * margin), int((y1 - y0) * margin)
    return max(0, y0 - my), min(h, y1 + my), max(0, x0 - mx), min(w, x1 + mx)


def probabilities(raw: np.ndarray) -> np.ndarray:
    """A model's output as 0..1: values beyond are taken as logits; what is no number is 0."""
    x = np.asarray(raw, dtype=np.float64)
    if x.size and (np.nanmin(x) < 0 or np.nanmax(x) > 1):
        x = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
    return np.clip(np.nan_to_num(x, nan=0.0), 0, 1)


def one_pass(rgb: np.ndarray, box: tuple | None, model: Model, margin: float = MARGIN, side: int | None = SIDE) -> tuple[np.ndarray, tuple]:
    """(alpha of the frame, 0 outside of the crop; the crop): the crop, fitted into a square of ``side``, through the model and pasted back.

    Without a side the model gets the crop in its own size.
    """
    h, w = rgb.shape[:2]
    y0, y1, x0, x1 = crop_of(box, h, w, margin)
    out = np.zeros((h, w))
    if y1 <= y0 or x1 <= x0:
        return out, (y0, y1, x0, x1)
    part = rgb[y0:y1, x0:x1]
    if side is None:
        found = probabilities(model(part))
    else:
        square, factor = crop_to(part, side, 0)
        inner = tuple(max(1, int(n * factor)) for n in part.shape[:2])
        found = bilinear(probabilities(model(square))[: inner[0], : inner[1]], *part.shape[:2])
    out[y0:y1, x0:x1] = found
    return out, (y0, y1, x0, x1)


def cut_off(alpha: np.ndarray, crop: tuple) -> bool:
    """Whether the subject touches an edge of the crop that isn't the frame's own."""
    (h, w), (y0, y1, x0, x1) = alpha.shape, crop
    if y1 <= y0 or x1 <= x0:
        return False
    part = alpha[y0:y1, x0:x1] > TOUCH
    return bool((y0 > 0 and part[0].any()) or (y1 < h and part[-1].any()) or (x0 > 0 and part[:, 0].any()) or (x1 < w and part[:, -1].any()))


def _box(box: dict | None) -> tuple | None:
    return None if box is None or any(box[c] is None for c in B.BOX) else tuple(box[c] for c in B.BOX)


def _mattes(frames: DataFrame, model: Callable[[], Model], margin: float, side: int | None, again: bool, refine: bool) -> DataFrame:
    """(clip_id, frame_idx, MATTE) by the column ``box``; with ``again`` a frame that is cut off gets a pass over all of it."""
    held: list[Model] = []

    def run(rgb: np.ndarray, a: np.ndarray | None, box: dict | None) -> dict:
        if not held:
            held.append(model())  # once a task
        box = _box(box)
        alpha, crop = one_pass(rgb, box, held[0], margin, side)
        truncated, passes = box is not None and cut_off(alpha, crop), 1
        if truncated and again:
            alpha, passes = one_pass(rgb, None, held[0], margin, side)[0], 2
        if refine:
            alpha = closedform.refined(rgb, alpha)
        return {"h": rgb.shape[0], "w": rgb.shape[1], "rgb": rgb, "a": np.rint(alpha * 255).astype(np.uint8), "truncated": truncated, "passes": passes}

    return P.map_packed(frames, run, MATTE, ("box",))


def cropped(frames: DataFrame, model: Callable[[], Model], margin: float = MARGIN, side: int | None = SIDE, fallback: bool = True, refine: bool = False) -> DataFrame:
    """(clip_id, frame_idx, h, w, rgb, a, truncated, passes): mattes of the crops by ``box`` (a struct of x0, y0, x1, y1, or null for all of the frame).

    ``model()`` is called once a task and takes colours to alpha.  A frame whose subject the crop
    cuts off is ``truncated`` and, with ``fallback``, matted once more as a whole; ``refine`` solves
    the soft band anew.
    """
    return _mattes(frames, model, margin, side, fallback, refine)


def repaired(frames: DataFrame, mattes: DataFrame, model: Callable[[], Model], margin: float = MARGIN, side: int | None = SIDE, merge: int = 3, share: float = 0.5, refine: bool = False) -> DataFrame:
    """``mattes`` with runs of truncated frames matted again in a grown box around all of the run's boxes, or whole where that is cut off too.

    ``frames`` has ``box``, ``mattes`` is what ``cropped`` gave for them without fallback and
    should be a written table.  ``passes`` counts the passes over all.
    """
    flagged = mattes.select("clip_id", "frame_idx", "h", "w", "truncated", F.col("passes").alias("_before")).join(frames.select("clip_id", "frame_idx", "box"), ["clip_id", "frame_idx"])
    boxes = flagged.select("clip_id", "frame_idx", "truncated", "h", "w", *(F.col(f"box.{c}").alias(c) for c in B.BOX))
    size = boxes.groupBy("clip_id").agg(F.first("h").alias("_h"), F.first("w").alias("_w"))
    runs = B.repairs(boxes, F.lit(float("inf")), F.lit(float("inf")), merge, share)  # cut to the frame below
    grown = [F.when(F.col(c).isNotNull(), F.least(F.col(c), F.col(end).cast("double"))).alias(c) for c, end in zip(B.BOX, ("_w", "_h", "_w", "_h"))]
    wanted = runs.join(size, "clip_id").select("clip_id", "frame_idx", F.when(F.col("x0").isNotNull(), F.struct(*grown)).alias("box"))
    anew = _mattes(frames.drop("box").join(wanted, ["clip_id", "frame_idx"]), model, margin, side, True, refine)
    anew = anew.join(flagged.select("clip_id", "frame_idx", "_before"), ["clip_id", "frame_idx"]).withColumn("passes", F.col("passes") + F.col("_before")).drop("_before")
    return mattes.join(wanted.select("clip_id", "frame_idx"), ["clip_id", "frame_idx"], "left_anti").unionByName(anew)


def window_around(mask: np.ndarray, least: int = 512, times: int = 5) -> tuple[int, int, int, int]:
    """(y0, y1, x0, x1) of a square around a mask's box, ``times`` its longer side and at least ``least``; at an edge of the frame it is shifted back inside."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    x, y, bw, bh = xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1
    side = max(least, times * max(bw, bh))
    x0, y0 = max(0, x + bw // 2 - side // 2), max(0, y + bh // 2 - side // 2)
    x1, y1 = min(w, x0 + side), min(h, y0 + side)
    return int(max(0, y1 - side)), int(y1), int(max(0, x1 - side)), int(x1)


def zoomed_verdict(model: Callable[[], Model], least: int = 512, times: int = 5, side: int | None = SIDE) -> Callable[[np.ndarray, np.ndarray], float]:
    """A verdict for ``matte.islands``: how much of an island a second look, at a window around it, calls backdrop."""
    held: list[Model] = []

    def verdict(rgb: np.ndarray, mask: np.ndarray) -> float:
        if not mask.any():
            return 0.0
        if not held:
            held.append(model())
        y0, y1, x0, x1 = window_around(mask, least, times)
        alpha, _ = one_pass(rgb[y0:y1, x0:x1], None, held[0], side=side)
        return float((alpha[mask[y0:y1, x0:x1]] < 0.5).mean())

    return verdict
