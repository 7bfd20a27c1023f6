"""Operators on the mattes of packed frames: clears of tracked islands, the main subject, topology, trimaps, smoothing, and their order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions import foreground as G
from framegrid.functions import kernels as K
from framegrid.functions import packed as P
from framegrid.functions.pixel import T_HI, T_LO
from framegrid.operators.evaluate import OPAQUE
from framegrid.operators.store import written
from framegrid.operators.temporal import by_frame

# Fixed values of the clears: saturation, areas of links and of clears, distance from the backdrop, verdict, overlap, gap and share of strong members.
CLEAR = {"sat": 12.0, "area_link": 600, "area": 2000, "dist": 60.0, "verdict": 0.5, "overlap": 0.30, "gap": 3, "strong": 0.30, "core": 2}
# Fixed values of the main subject: share of the largest component, dilation and overlap of the person's mask, rim in pixels.
SUBJECT = {"share": 0.25, "grow": 5, "overlap": 0.30, "rim": 5}
#: Least share of the frame that a component must have.
TOPOLOGY = 0.003


def _labels(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component labels of a mask, the labels present and their areas."""
    label = K.components(m)
    ids, areas = np.unique(label[label >= 0], return_counts=True)
    return label, ids, areas


def islands(frames: DataFrame, verdict: Callable[[np.ndarray, np.ndarray], float], rules: dict = CLEAR) -> DataFrame:
    """(clip_id, frame_idx, label, area, verdict, places, box): grey, compact islands near the backdrop's colour, each judged by ``verdict``.

    ``frames`` may have ``bg``, the backdrop's colour; null passes.  ``verdict`` takes a frame's
    colours and an island's mask and tells how much of it is backdrop.  ``places`` are its pixels,
    ``box`` its first and last row and column.
    """

    def run(rgb: np.ndarray, a: np.ndarray, bg: list | None) -> list[tuple]:
        x = rgb.astype(np.float64)
        top, low = x.max(axis=2), x.min(axis=2)
        sat = np.where(top > 0, (top - low) * 255 / np.maximum(top, 1), 0)
        label, ids, areas = _labels((a > OPAQUE) & (sat < rules["sat"]))
        out = []
        for k, n in zip(ids, areas):
            m = label == k
            if n < rules["area_link"]:
                continue
            core = P.shrink(m, P.square(rules["core"]))
            if not core.any() or bg is not None and np.linalg.norm(x[core].mean(axis=0) - np.array(bg)) > rules["dist"]:
                continue
            ys, xs = np.nonzero(m)
            out.append((int(k), int(n), float(verdict(rgb, m)), np.flatnonzero(m).astype("<i4").tobytes(), [int(v) for v in (ys.min(), ys.max(), xs.min(), xs.max())]))
        return out

    clip = frames.schema["clip_id"].dataType.simpleString()
    held = frames if "bg" in frames.columns else frames.withColumn("bg", F.lit(None).cast("array<double>"))

    def rows(batches):
        for b in batches:
            out = []
            for c, i, h, w, rgb, a, bg in zip(*(b[n] for n in ("clip_id", "frame_idx", "h", "w", "rgb", "a", "bg"))):
                out += [(c, i, *row) for row in run(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), np.frombuffer(a, np.uint8).reshape(h, w), bg)]
            yield pd.DataFrame(out, columns=["clip_id", "frame_idx", "label", "area", "verdict", "places", "box"])

    return held.select("clip_id", "frame_idx", "h", "w", "rgb", "a", "bg").mapInPandas(rows, f"clip_id {clip}, frame_idx int, label int, area long, verdict double, places binary, box array<int>")


def links(found: DataFrame, rules: dict = CLEAR) -> DataFrame:
    """(clip_id, f1, l1, f2, l2): islands up to ``gap`` frames apart that share ``overlap`` of the smaller one's pixels.

    Islands whose boxes meet are paired, and a pair's packed places are intersected where it is.
    """
    one = found.select("clip_id", F.col("frame_idx").alias("f1"), F.col("label").alias("l1"), F.col("places").alias("p1"), F.col("box").alias("b1")).withColumn("f2", F.explode(F.sequence(F.col("f1") + 1, F.col("f1") + rules["gap"])))
    two = found.select("clip_id", F.col("frame_idx").alias("f2"), F.col("label").alias("l2"), F.col("places").alias("p2"), F.col("box").alias("b2"))
    meet = (F.col("b1")[0] <= F.col("b2")[1]) & (F.col("b2")[0] <= F.col("b1")[1]) & (F.col("b1")[2] <= F.col("b2")[3]) & (F.col("b2")[2] <= F.col("b1")[3])
    paired = one.join(two, ["clip_id", "f2"]).where(meet).select("clip_id", "f1", "l1", "f2", "l2", "p1", "p2")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("p1").to_pylist(), batch.column("p2").to_pylist()):
                x, y = np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n > 0 and n >= rules["overlap"] * min(len(x), len(y)))
            yield batch.select(["clip_id", "f1", "l1", "f2", "l2"]).filter(pa.array(keep, pa.bool_()))

    clip = found.schema["clip_id"].dataType.simpleString()
    return paired.mapInArrow(shared, f"clip_id {clip}, f1 int, l1 int, f2 int, l2 int")


def tracks(found: DataFrame, linked: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, label, track_frame, track_label): every island with the first island of its track.

    A clip's links fit in one task: admission holds clips to 1800 frames.
    """

    def union(rows: pd.DataFrame) -> pd.DataFrame:
        parent: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for f1, l1, f2, l2 in rows[["f1", "l1", "f2", "l2"]].itertuples(index=False):
            x, y = root((f1, l1)), root((f2, l2))
            parent[max(x, y)] = min(x, y)
        every = sorted({(f, k) for a, b in (("f1", "l1"), ("f2", "l2")) for f, k in zip(rows[a], rows[b])})
        tops = [root(x) for x in every]
        return pd.DataFrame({"clip_id": rows["clip_id"].iloc[0], "frame_idx": [x[0] for x in every], "label": [x[1] for x in every], "track_frame": [x[0] for x in tops], "track_label": [x[1] for x in tops]})

    clip = found.schema["clip_id"].dataType.simpleString()
    own = linked.groupBy("clip_id").applyInPandas(union, f"clip_id {clip}, frame_idx int, label int, track_frame int, track_label int")
    out = found.select("clip_id", "frame_idx", "label").join(own, ["clip_id", "frame_idx", "label"], "left")
    return out.select("clip_id", "frame_idx", "label", F.coalesce("track_frame", "frame_idx").alias("track_frame"), F.coalesce("track_label", "label").alias("track_label"))


def cleared_islands(found: DataFrame, tracked: DataFrame, rules: dict = CLEAR) -> DataFrame:
    """The islands of tracks of which enough are surely backdrop and one of those is large: (found's columns)."""
    both = found.join(tracked, ["clip_id", "frame_idx", "label"])
    strong = F.col("verdict") >= rules["verdict"]
    judged = both.groupBy("clip_id", "track_frame", "track_label").agg(F.count_if(strong).alias("strong"), F.count("*").alias("n"), F.max(F.when(strong, F.col("area"))).alias("largest"))
    fired = judged.where((F.col("strong") > 0) & (F.col("strong") >= rules["strong"] * F.col("n")) & (F.col("largest") >= rules["area"]))
    return both.join(fired.select("clip_id", "track_frame", "track_label"), ["clip_id", "track_frame", "track_label"], "left_semi").select(*found.columns)


def cleared(frames: DataFrame, fired: DataFrame) -> DataFrame:
    """``frames`` with the fired islands transparent."""
    gone = fired.groupBy("clip_id", "frame_idx").agg(F.collect_list("places").alias("gone"))

    def run(rgb: np.ndarray, a: np.ndarray, gone: list | None) -> dict:
        out = a.copy().ravel()
        for p in gone or ():
            out[np.frombuffer(p, "<i4")] = 0
        return {"h": a.shape[0], "w": a.shape[1], "rgb": rgb, "a": out}

    return P.map_packed(frames.join(gone, ["clip_id", "frame_idx"], "left"), run, FRAME, ("gone",))


FRAME = "h int, w int, rgb binary, a binary"


def _alpha_only(frames: DataFrame, kernel: Callable[..., np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """``frames`` with alpha made anew by ``kernel(rgb, a, extra...)``."""

    def run(rgb: np.ndarray, a: np.ndarray, *others) -> dict:
        return {"h": a.shape[0], "w": a.shape[1], "rgb": rgb, "a": kernel(rgb, a, *others).astype(np.uint8)}

    return P.map_packed(frames, run, FRAME, extra)


def main_subject(a: np.ndarray, box: dict | None = None, person: bytes | None = None, rules: dict = SUBJECT) -> np.ndarray:
    """Alpha without the opaque components that aren't the subject's, nor the soft rims around those alone.

    Kept are the largest, those of a share of it, and where there is a box those that enough of
    the person's grown mask covers, or without a mask those that the box touches.
    """
    label, ids, areas = _labels(a > OPAQUE)
    if len(ids) < 2:
        return a
    keep = areas >= rules["share"] * areas.max()
    if box is not None and all(box[c] is not None for c in ("x0", "y0", "x1", "y1")):
        m = np.frombuffer(person, np.uint8).reshape(a.shape) > OPAQUE if person is not None else None
        if m is not None and m.any():
            wide = P.spread(m, P.ellipse(rules["grow"]))
            covered = np.array([wide[label == k].sum() for k in ids])
            keep |= covered / areas >= rules["overlap"]
        else:
            x0, y0, x1, y1 = (int(np.rint(box[c])) for c in ("x0", "y0", "x1", "y1"))
            inside = label[max(0, y0) : max(0, min(a.shape[0], y1)), max(0, x0) : max(0, min(a.shape[1], x1))]
            keep |= np.isin(ids, inside)
    if keep.all():
        return a
    kept = np.isin(label, ids[keep])
    drop = (label >= 0) & ~kept
    rim = P.ellipse(rules["rim"])
    near = P.spread(drop, rim) & ~P.spread(kept, rim) if rules["rim"] else False
    return np.where(drop | near, 0, a)


def keep_main_subject(frames: DataFrame, rules: dict = SUBJECT) -> DataFrame:
    """``main_subject`` of every frame; ``frames`` has ``box`` (struct or null) and ``person`` (a mask or null)."""
    return _alpha_only(frames, lambda rgb, a, box, person: main_subject(a, box, person, rules), ("box", "person"))


def topology(a: np.ndarray, share: float = TOPOLOGY) -> np.ndarray:
    """Alpha without components of less than ``share`` of the frame, holes of what is left filled."""
    label, ids, areas = _labels(a > OPAQUE)
    kept = np.where(np.isin(label, ids[areas >= share * a.size]), a, 0)
    return np.where(K.holes(kept > OPAQUE), 255, kept)


def despilled(frames: DataFrame, band_only: bool = True) -> DataFrame:
    """``frames`` with the backdrop's share taken off the colours of mixed pixels, by estimated foregrounds."""

    def run(rgb: np.ndarray, a: np.ndarray) -> dict:
        return {"h": a.shape[0], "w": a.shape[1], "rgb": G.despill(rgb, a, band_only), "a": a}

    return P.map_packed(frames, run, FRAME)


def inferred(frames: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``frames`` with the alpha that a model gives: ``model()`` runs once in each task and gives a function of colours to levels of 0..255."""
    held: list = []

    def run(rgb: np.ndarray, a: np.ndarray | None) -> dict:
        if not held:
            held.append(model())
        return {"h": rgb.shape[0], "w": rgb.shape[1], "rgb": rgb, "a": np.asarray(held[0](rgb)).astype(np.uint8)}

    return P.map_packed(frames, run, FRAME)


def routed(frames: DataFrame, models: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Clips whose backdrop is safe are keyed by colour, all others go to ``model``: the mattes of all clips."""
    from framegrid.operators.keyer import key

    safe = models.where("safe")
    return key(frames, safe).unionByName(inferred(frames.join(safe.select("clip_id"), "clip_id", "left_anti"), model))


def trimap(a: np.ndarray, r: int, seed: np.ndarray | None = None, variant: str = "additive", ramp: np.ndarray | None = None, sure: float = 0.90, maybe: float = 0.10, element: Callable[[int], list] = P.ellipse) -> np.ndarray:
    """Alpha 1 in the sure part, 0 outside the possible part, ``ramp`` (or the raw alpha) between.

    Both parts keep ``r`` pixels from each other's, by ``element``.
    Without a seed both parts come from alpha; with one the "additive" form only adds to what
    alpha is sure of, and the "symmetric" one goes by the seed alone; another form is an error.
    """
    e = element(r)
    if seed is None:
        fg, bg = P.shrink(a > sure, e), ~P.spread(a > maybe, e)
    elif variant == "additive":
        fg, bg = P.shrink(seed, e) | (a > sure), ~P.spread(seed, e) & (a < maybe)
    elif variant == "symmetric":
        fg, bg = P.shrink(seed, e), ~P.spread(seed, e)
    else:
        raise ValueError(f"unknown form of seeded trimap: {variant!r}")
    return np.where(fg, 1.0, np.where(bg, 0.0, np.clip(a if ramp is None else ramp, 0, 1)))


def distance_ramp(rgb: np.ndarray, model: dict) -> np.ndarray:
    """Alpha by the distance from the backdrop, smoothed by the median of each pixel and its neighbours: 0 at what is surely backdrop, 1 at what is surely not."""
    d = K.median3(P.distance_from(rgb.astype(np.float64), model))
    return np.clip((d - T_LO) / (T_HI - T_LO), 0, 1)


def trimaps(frames: DataFrame, r: int, variant: str | None = None, ramp: bool = False, element: Callable[[int], list] = P.ellipse) -> DataFrame:
    """(clip_id, frame_idx, t array<double>): trimaps of alpha, by ``seed`` (a mask column) where a form is given.

    Between the sure parts stands the raw alpha or, with ``ramp``, that of the distance from the
    backdrop in ``model``.
    """

    def run(rgb: np.ndarray, a: np.ndarray, *others) -> dict:
        own = np.frombuffer(others[0], np.uint8).reshape(a.shape) > OPAQUE if variant else None
        between = distance_ramp(rgb, others[-1]) if ramp else None
        return {"t": trimap(a / 255.0, r, own, variant or "additive", between, element=element).ravel().tolist()}

    return P.map_packed(frames, run, "t array<double>", (*(["seed"] if variant else []), *(["model"] if ramp else [])))


def normal_alpha(alpha: Column) -> Column:
    """Values of 0..1: not a number is 0, infinities are the ends."""
    return F.transform(alpha, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))


def uncollapsed(frames: DataFrame, ratio: float = 0.6) -> DataFrame:
    """A frame whose opaque area is below ``ratio`` of both neighbours' takes the frame before; areas are the original ones."""
    areas = P.map_packed(frames, lambda rgb, a: {"area": int((a > OPAQUE).sum())}, "area long")
    w = by_frame()
    fell = areas.withColumn("fell", F.coalesce((F.col("area") < F.lag("area").over(w) * ratio) & (F.col("area") < F.lead("area").over(w) * ratio), F.lit(False)))
    source = fell.select("clip_id", "frame_idx", F.when(F.col("fell"), F.col("frame_idx") - 1).otherwise(F.col("frame_idx")).alias("_from"))
    held = frames.withColumnRenamed("frame_idx", "_from")
    return source.join(held, ["clip_id", "_from"]).select("clip_id", "frame_idx", "h", "w", "rgb", "a")


def without_fringe(frames: DataFrame, candidates: Callable, stats: DataFrame, most: float = 0.005) -> DataFrame:
    """Fringe candidates transparent in the clips where they stay out of the subject's inside."""
    from framegrid.operators.evaluate import fringe_safety
    from framegrid.operators.keyer import _with_model

    safe = fringe_safety(frames, candidates, stats, most).select("clip_id", "safe")
    held = _with_model(frames, stats.join(safe, "clip_id"))
    return _alpha_only(held, lambda rgb, a, m: np.where(candidates(rgb, a, m), 0, a) if m["safe"] else a, ("model",))


def postprocess(frames: DataFrame, verdict: Callable, candidates: Callable, stats: DataFrame, clear: dict = CLEAR, subject: dict = SUBJECT, most: float = 0.005, half: int = 1, **search) -> DataFrame:
    """All stages in their fixed order: clears, collapsed frames, steadying along the flow, main subject, fringe.

    Each works on what the one before left; another order gives another result.  A stage whose
    rows are used more than once is written once.
    """
    from framegrid.operators.motion import steadied

    held = written(frames.select("clip_id", "frame_idx", "h", "w", "rgb", "a", *(["bg"] if "bg" in frames.columns else [])))
    found = written(islands(held, verdict, clear))
    fired = cleared_islands(found, written(tracks(found, links(found, clear))), clear)
    out = steadied(uncollapsed(written(cleared(held, fired))), half, **search)
    none = out.withColumn("box", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")).withColumn("person", F.lit(None).cast("binary"))
    return without_fringe(written(keep_main_subject(none, subject)), candidates, written(stats), most)
