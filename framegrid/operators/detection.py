"""Operators on boxes found in frames: choice of the subject, growth within the frame, suppression of overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions import kernels as K

# Class of people, least confidence of any box, confidence at which a person of any size counts.
PERSON, LEAST_CONF, SURE_CONF = 0, 0.25, 0.8


def subject_box(boxes: DataFrame, keys: list[str], frame_area: int, least: float = 0.05) -> DataFrame:
    """(keys, det): a frame's subject, people before others, then the largest, then the first.

    Null where the subject covers less than ``least`` of the frame and isn't surely a person;
    frames without a box of enough confidence have no row.  One aggregation, combined before the shuffle.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rank = F.struct((F.col("cls") != PERSON).alias("other"), (-area).alias("size"), "det", "conf")
    best = boxes.where(F.col("conf") >= LEAST_CONF).groupBy(*keys).agg(F.min(rank).alias("b"))
    fits = (~F.col("b.other") & (F.col("b.conf") >= SURE_CONF)) | (-F.col("b.size") >= least * frame_area)
    return best.select(*keys, F.when(fits, F.col("b.det")).alias("det"))


def grow(x0: Column, y0: Column, x1: Column, y1: Column, share: float, w: int, h: int) -> tuple[Column, ...]:
    """The box with a margin of ``share`` of its sides, cut to whole pixels within the frame."""
    mx, my = (x1 - x0) * share, (y1 - y0) * share
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    return low(x0 - mx).alias("x0"), low(y0 - my).alias("y0"), F.least(F.lit(w), (x1 + mx).cast("int")).alias("x1"), F.least(F.lit(h), (y1 + my).cast("int")).alias("y1")


def letterbox(w: Column, h: Column, side: int = 640) -> tuple[Column, Column, Column]:
    """(factor, width, height) of a frame fitted into a detector's square input."""
    factor = F.least(side / h, side / w)
    return factor.alias("factor"), F.rint(w * factor).cast("int").alias("nw"), F.rint(h * factor).cast("int").alias("nh")


def decoded(raw: DataFrame, factor: Column, least: float = LEAST_CONF) -> DataFrame:
    """``raw`` (cx, cy, bw, bh, objectness, scores) as boxes of the frame: x0, y0, x1, y1, cls and conf for those above ``least``.

    Sizes are in the detector's input; the class is the first of the highest scores, the confidence
    objectness times that score.
    """
    top = F.array_max("scores")
    out = raw.withColumns({"cls": (F.array_position("scores", top) - 1).cast("int"), "conf": F.col("objectness") * top, "_f": factor}).where(F.col("conf") > least)
    half = lambda c, size, sign: (F.col(c) + sign * F.col(size) / 2) / F.col("_f")
    return out.withColumns({"x0": half("cx", "bw", -1), "y0": half("cy", "bh", -1), "x1": half("cx", "bw", 1), "y1": half("cy", "bh", 1)}).drop("_f", "cx", "cy", "bw", "bh", "objectness", "scores")


def zoom_side(w: Column, h: Column, least: int = 512, times: int = 5) -> Column:
    """Side of the square window around a box."""
    return F.greatest(F.lit(least), times * F.greatest(w, h)).cast("int")


def non_maximum(boxes: DataFrame, keys: list[str], overlap: float = 0.45, least: float = LEAST_CONF) -> DataFrame:
    """(keys, det): boxes kept by greedy suppression, best first; equal confidences by ``det``.

    A group is one frame's boxes, which detectors bound; frames are spread by key.
    """
    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in [*keys, "det"])
    sides = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "conf")))
    held = boxes.where(F.col("conf") >= least).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("det", sides.alias("b")))).alias("all"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, dets, b in batch.itertuples(index=False):
                b = np.stack(list(b))
                out += [(*key, dets[k]) for k in sorted(K.keep_boxes(b[:, :4], b[:, 4], overlap))]
            yield pd.DataFrame(out, columns=[*keys, "det"])

    return held.select(*keys, F.col("all.det").alias("dets"), F.col("all.b").alias("b")).mapInPandas(run, kinds)


def detect(frames: DataFrame, model, fields: str = "x0 double, y0 double, x1 double, y1 double, cls int, conf double") -> DataFrame:
    """(clip_id, frame_idx, det, fields): ``model()`` is called once per task and gives a function of a frame's pixels to a list of rows."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = model()
        for b in batches:
            out = [(c, i, k, *row) for c, i, h, w, d in zip(b["clip_id"], b["frame_idx"], b["h"], b["w"], b["data"]) for k, row in enumerate(infer(np.asarray(d).reshape(h, w)))]
            yield pd.DataFrame(out, columns=["clip_id", "frame_idx", "det", *names])

    return frames.select("clip_id", "frame_idx", "h", "w", "data").mapInPandas(run, f"clip_id {frames.schema['clip_id'].dataType.simpleString()}, frame_idx int, det int, {fields}")
