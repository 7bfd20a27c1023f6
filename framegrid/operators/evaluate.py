"""All quality metrics of a clip's output against its source, on packed frames.

Frames meet their neighbours in short stretches of a clip, and what is needed over all frames of
a clip (pixels that stand still) is folded in each task, merged to one plane and handed to the
stretches, so no step has a whole clip in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions import flow as W
from framegrid.functions import kernels as K
from framegrid.functions import packed as P
from framegrid.functions.flow import flow_between
from framegrid.functions.resample import resized
from framegrid.operators.folds import clip_fold
from framegrid.operators.keyer import _with_model
from framegrid.operators.quality import JUMP, OPAQUE, area_jump_of
from framegrid.operators.store import written
from framegrid.operators.temporal import worst

# Distances that are surely subject and surely backdrop, and the rings in pixels.
SUBJECT, BACKDROP, RING, MARGIN = 8.0, 3.0, 2, 10


#: Steps along a contour, clockwise from the right.
STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def contour_length(m: np.ndarray) -> float:
    """Length of the outer contours of a mask, from pixel to pixel: sideways steps count one, diagonal ones the root of two.

    Components that lie in a hole of another have no outer contour, nor do holes; a pixel alone has length 0.
    """
    on = np.pad(m, 1)
    label = K.components(on)
    outside = K.components(~on, K.FOUR) == 0
    next_to = np.zeros_like(on)
    for dy, dx in K.FOUR:
        next_to |= K.shifted(outside, dy, dx, True)
    straight = slanted = 0
    for start in np.unique(label[on & next_to]).tolist():
        y, x = divmod(start, on.shape[1])  # the first pixel by rows: nothing of the component is above or left of it
        move, first = 0, None
        while True:
            turn = next((k for k in range(8) if on[y + STEPS[(move + 5 + k) % 8][0], x + STEPS[(move + 5 + k) % 8][1]]), None)
            if turn is None:
                break
            move = (move + 5 + turn) % 8
            y, x = y + STEPS[move][0], x + STEPS[move][1]
            if first == (y, x, move):
                break
            first = first or (y, x, move)
            straight, slanted = straight + (move % 2 == 0), slanted + move % 2
    return straight + slanted * 2**0.5


def frame_metrics(joined: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(clip_id, frame_idx, f1, f1i, f2, f3, area, e1, e2, a2) from source colours ``source``, output colours, alpha and the clip's model."""

    def run(rgb: np.ndarray, a: np.ndarray, m: dict, source: bytes) -> dict:
        src = np.frombuffer(source, np.uint8).reshape(rgb.shape).astype(np.float64)
        d, opaque = P.distance_from(src, m), a > OPAQUE
        erased = (d > SUBJECT) & (a < OPAQUE)
        inner, outer = P.shrink(opaque, P.square(RING)), P.spread(opaque, P.square(RING))
        edge, ring = opaque & ~inner, outer & ~inner
        area = int(opaque.sum())
        return {
            "f1": int(erased.sum()),
            "f1i": int((erased & ~P.spread(d < BACKDROP, P.disc(margin))).sum()),
            "f2": int(((d < BACKDROP) & (a >= OPAQUE)).sum()),
            "f3": int(K.holes(opaque).sum()),
            "area": area,
            "e1": round(contour_length(opaque) / area**0.5, 9) if area else 0.0,
            "e2": float(P.distance_from(rgb.astype(np.float64), m)[edge].mean()) if edge.any() else None,
            "a2": float(((a > 0) & (a < 255))[ring].mean()) if ring.any() else 0.0,
        }

    counts = ", ".join(f"{n} long" for n in ("f1", "f1i", "f2", "f3", "area"))
    return P.map_packed(joined, run, f"{counts}, e1 double, e2 double, a2 double", ("model", "source"))


def pair_metrics(joined: DataFrame, still: float = 1.0, **search) -> DataFrame:
    """(clip_id, frame_idx, s1, s2): pixels whose mask differs from where they are in the next frame, along the
    source's flow, and those opaque in both whose colour jumps though the source there changes by less than ``still`` on average."""

    def steps(window: list) -> dict:
        here, then = window
        if then is None:
            return {"s1": None, "moved": None, "hits": None}
        x, y = (np.frombuffer(f["source"], np.uint8).reshape(f["rgb"].shape) for f in window)
        on, after = here["a"] > OPAQUE, then["a"] > OPAQUE
        along = flow_between(W.grey(x), W.grey(y), **search)
        jump = np.abs(here["rgb"].astype(np.int64) - then["rgb"]).max(axis=2) > JUMP
        moved = np.abs(x.astype(np.int64) - y).max(axis=2).astype(np.uint8)
        return {"s1": int((on != W.warp(after, along, nearest=True)).sum()), "moved": moved, "hits": np.packbits(on & after & jump)}

    found = written(P.map_window(joined, 0, 1, steps, "s1 long, moved binary, hits binary", ("source",)).where("s1 is not null"))
    totals = clip_fold(found, ("moved",), lambda x: [x.astype(np.int64), np.ones(1, np.int64)], lambda s, t: [a + b for a, b in zip(s, t)])

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(total, np.int64) / np.frombuffer(n, np.int64)[0] < still).tobytes() for total, n in batch.column("state").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(bits, pa.binary())], names=["clip_id", "quiet"])

    clip = joined.schema["clip_id"].dataType.simpleString()
    both = P.with_clip(found.select("clip_id", "frame_idx", "s1", "hits"), totals.mapInArrow(quiet, f"clip_id {clip}, quiet binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.unpackbits(np.frombuffer(h, np.uint8) & np.frombuffer(q, np.uint8)).sum()) for h, q in zip(batch.column("hits").to_pylist(), batch.column("quiet").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("clip_id", "frame_idx", "s1")), pa.array(n, pa.int64())], names=["clip_id", "frame_idx", "s1", "s2"])

    return both.select("clip_id", "frame_idx", "s1", "hits", "quiet").mapInArrow(count, f"clip_id {clip}, frame_idx int, s1 long, s2 long")


def frozen_pixels(frames: DataFrame) -> DataFrame:
    """(clip_id, s3): pixels of the output that are always opaque and never change in any colour."""

    def first(rgb: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
        return [rgb.copy(), rgb.copy(), a > OPAQUE]

    folded = clip_fold(frames, ("rgb", "a"), first, lambda s, t: [np.minimum(s[0], t[0]), np.maximum(s[1], t[1]), s[2] & t[2]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for low, high, on in batch.column("state").to_pylist():
                same = (np.frombuffer(low, np.uint8) == np.frombuffer(high, np.uint8)).reshape(-1, 3).all(axis=1)
                n.append(int((same & np.frombuffer(on, bool)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(n, pa.int64())], names=["clip_id", "s3"])

    return folded.mapInArrow(count, f"clip_id {frames.schema['clip_id'].dataType.simpleString()}, s3 long")


def fitted(source: DataFrame, output: DataFrame) -> DataFrame:
    """The output's frames with the source's colours, averaged or interpolated to the output's size, as ``source``; frames in both."""
    side = source.select("clip_id", "frame_idx", F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("rgb").alias("_rgb"))
    both = output.join(side, ["clip_id", "frame_idx"])

    def run(rgb: np.ndarray, a: np.ndarray, h: int, w: int, source: bytes) -> dict:
        x = resized(np.frombuffer(source, np.uint8).reshape(h, w, 3), *a.shape)
        return {"h": rgb.shape[0], "w": rgb.shape[1], "rgb": rgb, "a": a, "source": x}

    return P.map_packed(both, run, "h int, w int, rgb binary, a binary, source binary", ("_h", "_w", "_rgb"))


def raw_alpha_sad(output: DataFrame, raw: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, sad): mean difference from the raw alpha, an array<double> of 0..1 or 0..255.

    A clip whose raw values never exceed 1 is of the first kind; an array of another size is an error.
    """
    top = raw.groupBy("clip_id").agg(F.max(F.array_max("raw")).alias("_top"))
    both = output.join(raw, ["clip_id", "frame_idx"]).join(top, "clip_id")

    def run(rgb: np.ndarray, a: np.ndarray, raw: list, top: float) -> dict:
        x = np.array(raw, dtype=np.float64)
        if x.size != a.size:
            raise ValueError(f"raw alpha of {x.size} values for an output of {a.size}")
        x = np.clip(x, 0, 1) * 255 if top <= 1 + 1e-6 else x
        return {"sad": float(np.abs(a.ravel() - x).mean())}

    return P.map_packed(both, run, "sad double", ("raw", "_top"))


def evaluate(source: DataFrame, output: DataFrame, stats: DataFrame, margin: float = MARGIN, still: float = 1.0, raw: DataFrame | None = None, **search) -> DataFrame:
    """One wide row per clip with all metrics; those that measure distances from the backdrop are null where it isn't flat.

    ``stats`` has the clips' backdrops and ``flat``, ``raw`` the alpha before it was stored, without
    which a1 is null.  Worst frames are the first of equals; of e2, where more is better, the worst
    is the least.
    """
    stats, joined = written(stats), written(fitted(source, output))
    frames = written(frame_metrics(_with_model(joined, stats), margin))
    flat = lambda c: F.when(F.col("flat"), c)
    least = F.min_by("frame_idx", F.when(F.col("e2").isNotNull(), F.struct("e2", "frame_idx")))
    bad = lambda c, how: (how(c).alias(f"{c}_{'mean' if how is F.avg else 'total'}"), worst(c).alias(f"{c}_worst_frame"), F.max(c).alias(f"{c}_worst"))
    one = frames.groupBy("clip_id").agg(
        *(x for c in ("f1", "f1i", "f2", "f3") for x in bad(c, F.sum)),
        F.coalesce(F.percentile(F.when(F.col("e1") > 0, F.col("e1")), F.lit(0.5)), F.lit(0.0)).alias("e1_median"), worst("e1").alias("e1_worst_frame"), F.max("e1").alias("e1_worst"),
        F.coalesce(F.avg("e2"), F.lit(0.0)).alias("e2_mean"), F.coalesce(F.min("e2"), F.lit(0.0)).alias("e2_worst"), F.coalesce(least, F.lit(0)).alias("e2_worst_frame"),
        *bad("a2", F.avg),
    )
    steps = pair_metrics(joined, still, **search).groupBy("clip_id").agg(*(x for c in ("s1", "s2") for x in (*bad(c, F.sum), F.avg(c).alias(f"{c}_mean"))))
    wide = stats.select("clip_id", "flat").join(one, "clip_id").join(steps, "clip_id", "left").join(frozen_pixels(output), "clip_id", "left")
    wide = wide.join(area_jump_of(frames.select("clip_id", "frame_idx", "area")), "clip_id", "left")
    if raw is None:
        wide = wide.withColumns({"a1_mean": F.lit(None).cast("double"), "a1_worst_frame": F.lit(None).cast("int"), "a1_worst": F.lit(None).cast("double")})
    else:
        wide = wide.join(raw_alpha_sad(output, raw).select("clip_id", "frame_idx", F.round("sad", 9).alias("a1")).groupBy("clip_id").agg(*bad("a1", F.avg)), "clip_id", "left")
    by_distance = [c for c in one.columns if c.startswith(("f1", "f2", "e2"))]
    whole: list[str | Column] = [flat(F.col(c)).alias(c) if c in by_distance else c for c in wide.columns]
    return wide.select(*whole)


def fringe_safety(frames: DataFrame, candidates: Callable[[np.ndarray, np.ndarray, dict], np.ndarray], stats: DataFrame, most: float = 0.005) -> DataFrame:
    """(clip_id, fraction, safe): how much of the opaque part are candidates deep inside it.

    Deep is further than a hundredth of the diagonal, one pixel at least, from anything transparent.
    """

    def run(rgb: np.ndarray, a: np.ndarray, m: dict) -> dict:
        opaque = a > OPAQUE
        r = max(1, int(np.rint(np.hypot(*opaque.shape) * 0.01)))
        return {"hits": int((candidates(rgb, a, m) & P.shrink(opaque, P.ellipse(r))).sum()), "opaque": int(opaque.sum())}

    n = P.map_packed(_with_model(frames, stats), run, "hits long, opaque long", ("model",)).groupBy("clip_id").agg(F.sum("hits").alias("hits"), F.sum("opaque").alias("opaque"))
    fraction = F.col("hits") / F.greatest("opaque", F.lit(1))
    return n.select("clip_id", fraction.alias("fraction"), (fraction <= most).alias("safe"))
