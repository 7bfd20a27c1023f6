"""The keyer as a whole: frames sampled, backdrop measured, model joined to all frames, alpha and unmixed colours.

Only the counted colours of the borders and the largest distances of at most 24 frames of a clip
are brought together, so a clip's model needs bounded memory however long the clip is; all other
work is frame by frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.functions import pixel
from framegrid.functions.pixel import CHROMA_SHARE, MIN_SATURATION, T_LO
from framegrid.operators import stats
from framegrid.operators.store import written

#: Models of at most so many clips are broadcast to the frames; beyond it the frames are shuffled by clip.
BROADCAST_CLIPS = 100_000
# Frames sampled, near and far backdrop in deviations, percentile of the far backdrop, alphas that count as mixed.
SAMPLED, KEEP, NEAR, FAR_PERCENT, MIXED = 24, 5.0, 8.0, 99.9, (0.004, 0.996)


def evenly(n: Column, k: int = SAMPLED) -> Column:
    """Places of at most ``k`` evenly spaced frames of ``n``, first and last included."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / float(k - 1)).cast("int")))


def upload_places(n: Column, k: int = 5) -> Column:
    """Places of the frames looked at on upload."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(n - 1, F.rint(i * n / float(k))).cast("int")))


def sample(frames: DataFrame, places=evenly) -> DataFrame:
    """The frames at ``places``; a clip's frames are numbered from 0."""
    n = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    wanted = n.select("clip_id", F.explode(places(F.col("n"))).alias("frame_idx"))
    return frames.join(wanted, ["clip_id", "frame_idx"], "left_semi")


def backdrop(frames: DataFrame, ring: int = 24) -> DataFrame:
    """(clip_id, mu_u, mu_v, sd_u, sd_v, share, bg_r, bg_g, bg_b) of the frames' borders of ``ring`` pixels.

    Colours are counted, ``once`` by border pixels and in ``strips`` by the four sides (corners
    twice), and Spark works on the counts: no task of Python holds a clip's colours, and a clip's
    medians are exact over its different values.  The colour is the median of those like the
    backdrop, or of all where none is.
    """
    clip = frames.schema["clip_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, w = (batch.column(c)[k].as_py() for c in ("h", "w"))
                x = np.frombuffer(batch.column("rgb")[k].as_buffer(), np.uint8).reshape(h, w, 3).astype(np.int32)
                code = x[..., 0] << 16 | x[..., 1] << 8 | x[..., 2]
                edge = np.ones(code.shape, bool)
                edge[ring:-ring, ring:-ring] = False
                strips = np.concatenate([part.ravel() for part in (code[:ring], code[-ring:], code[:, :ring], code[:, -ring:])])
                colours, once = np.unique(code[edge], return_counts=True)
                n = np.unique(strips, return_counts=True)[1]  # the same colours, more often
                own = pa.array([batch.column("clip_id")[k].as_py()] * len(colours), batch.schema.field("clip_id").type)
                yield pa.RecordBatch.from_arrays([own, pa.array(colours), pa.array(once), pa.array(n)], names=["clip_id", "colour", "once", "strips"])

    counted = frames.select("clip_id", "h", "w", "rgb").mapInArrow(count, f"clip_id {clip}, colour int, once long, strips long")
    r, g, b = (F.shiftright("colour", k).bitwiseAND(255).cast("double") for k in (16, 8, 0))
    sums = counted.groupBy("clip_id", "colour").agg(F.sum("once").alias("once"), F.sum("strips").alias("strips"))
    colours = written(sums.select("clip_id", r.alias("r"), g.alias("g"), b.alias("b"), pixel.cb(r, g, b).alias("u"), pixel.cr(r, g, b).alias("v"), "once", "strips"))
    model = written(stats.sigma_clip(colours, keep=KEEP, n=F.col("once")).drop("flat"))
    d = pixel.chroma_distance(*(F.col(c) for c in ("u", "v", "mu_u", "mu_v", "sd_u", "sd_v")))
    like = {f"like_{c}": (F.when(d < T_LO, F.col(c)), 0.5) for c in "rgb"}
    middle = stats.percentiles(colours.join(model, "clip_id"), like | {f"any_{c}": (F.col(c), 0.5) for c in "rgb"}, F.col("strips"))
    back = middle.select("clip_id", *(F.coalesce(f"like_{c}", f"any_{c}").alias(f"bg_{c}") for c in "rgb"))
    return model.join(back, "clip_id").select("clip_id", "mu_u", "mu_v", "sd_u", "sd_v", "share", "bg_r", "bg_g", "bg_b")


def scaled(stats: DataFrame, slope: float = 0.5) -> DataFrame:
    """Adds saturation, neutral (distance of grey), flat, t_lo and t_hi before the far backdrop is measured."""
    grey = F.hypot((128 - F.col("mu_u")) / F.col("sd_u"), (128 - F.col("mu_v")) / F.col("sd_v"))
    out = stats.withColumns({"saturation": F.hypot(F.col("mu_u") - 128, F.col("mu_v") - 128), "neutral": grey, "flat": F.col("share") > CHROMA_SHARE})
    return out.withColumns({"t_lo": F.lit(T_LO), "t_hi": F.greatest(F.lit(T_LO + 1), F.col("neutral") * slope)})


def _with_model(frames: DataFrame, model: DataFrame) -> DataFrame:
    """Every frame with its clip's model as one struct."""
    side = model.select("clip_id", F.struct(*(c for c in model.columns if c != "clip_id")).alias("model"))
    return frames.join(F.broadcast(side) if side.limit(BROADCAST_CLIPS + 1).count() <= BROADCAST_CLIPS else side, "clip_id")


def far_backdrop(frames: DataFrame, model: DataFrame, far: float = 0.05) -> DataFrame:
    """(clip_id, p999) of the distances of pixels further than ``far`` of the long side from any opaque one.

    The percentile lies among the largest thousandth of a clip's values.  A clip has at most 24
    sampled frames, so each frame sends its number of values and so many of the largest.
    """

    def top(rgb: np.ndarray, a: np.ndarray | None, m: dict) -> dict:
        d = P.distance_from(rgb.astype(np.float64), m)
        opaque = d > m["t_hi"]
        own = d[~P.spread(opaque, P.disc(far * max(opaque.shape)))] if opaque.any() else d.ravel()
        k = min(len(own), int(np.ceil((1 - FAR_PERCENT / 100) * SAMPLED * d.size)) + 2)
        return {"n": len(own), "top": np.sort(own)[len(own) - k :]}

    def percentile(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        values = np.sort(np.frombuffer(b"".join(rows["top"]), np.float64))
        at = (n - 1) * FAR_PERCENT / 100 - (n - len(values))
        p = float(np.interp(at, np.arange(len(values)), values)) if n else None
        return pd.DataFrame({"clip_id": [rows["clip_id"].iloc[0]], "p999": pd.Series([p], dtype="float64")})

    tops = P.map_packed(_with_model(frames, model), top, "n long, top binary", ("model",))
    return tops.groupBy("clip_id").applyInPandas(percentile, f"clip_id {frames.schema['clip_id'].dataType.simpleString()}, p999 double")


def reason(flat: Column, saturation: Column, share: Column) -> Column:
    """Why a clip may or may not be keyed by colour alone."""
    return (
        F.when(~flat, F.format_string("backdrop is not flat (%.4f of the border is like it)", share))
        .when(saturation < MIN_SATURATION, F.format_string("backdrop is flat but nearly neutral (saturation %.1f)", saturation))
        .otherwise(F.format_string("flat backdrop of saturation %.0f", saturation))
    )


def keyable(flat: Column, saturation: Column) -> Column:
    """Whether a clip takes the colour-only route; what wasn't measured doesn't."""
    return F.coalesce(flat & (saturation >= MIN_SATURATION), F.lit(False))


def key_models(frames: DataFrame, ring: int = 24, slope: float = 0.5, far: float = 0.05, measured: bool = True) -> DataFrame:
    """One model per clip: backdrop, thresholds, whether it is safe to key by colour and why."""
    own = sample(frames)
    first = written(scaled(backdrop(own, ring), slope))
    p999 = far_backdrop(own, first, far) if measured else first.select("clip_id", F.lit(None).cast("double").alias("p999"))
    low = F.when(F.col("p999").isNull() | F.isnan("p999"), F.lit(T_LO)).otherwise(F.least(F.greatest(F.lit(T_LO), F.col("p999")), F.greatest(F.lit(T_LO), F.col("t_hi") / 2)))
    out = first.join(p999, "clip_id").withColumn("t_lo", low).withColumn("t_hi", F.greatest(F.col("t_lo") + 1, F.col("t_hi")))
    return written(out.withColumns({"safe": keyable(F.col("flat"), F.col("saturation")), "reason": reason(F.col("flat"), F.col("saturation"), F.col("share"))}))


def _unmixed(rgb: np.ndarray, band: np.ndarray, cover: np.ndarray, m: dict) -> np.ndarray:
    out = rgb.copy()
    if band.any():
        c = cover[band][:, None]
        exact = (rgb[band] - (1 - c) * np.array([m["bg_r"], m["bg_g"], m["bg_b"]])) / c
        out[band] = np.floor(np.clip(np.round(exact, 9), 0, 255)).astype(np.uint8)
    return out


def key_kernel(rgb: np.ndarray, m: dict, coverage: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Colours without the backdrop's share, and alpha, of one frame.

    With ``coverage`` the share is estimated on a ramp that ends at grey, over an edge of two
    pixels beside the not quite opaque ones; else on alpha itself where it is mixed.
    """
    d = P.distance_from(rgb.astype(np.float64), m)
    alpha = np.clip((d - m["t_lo"]) / (m["t_hi"] - m["t_lo"]), 0, 1)
    if coverage:
        cover = np.clip((d - m["t_lo"]) / max(m["neutral"] - m["t_lo"], m["t_hi"] - m["t_lo"]), 0, 1)
        band = P.spread(alpha < MIXED[1], P.ellipse(2)) & (alpha > MIXED[0]) & (cover < MIXED[1])
        return _unmixed(rgb, band, np.maximum(cover, MIXED[0]), m), np.rint(alpha * 255).astype(np.uint8)
    return _unmixed(rgb, (alpha > MIXED[0]) & (alpha < MIXED[1]), alpha, m), np.rint(alpha * 255).astype(np.uint8)


def key(frames: DataFrame, models: DataFrame, coverage: bool = True) -> DataFrame:
    """(clip_id, frame_idx, h, w, rgb, a): the frames keyed by their clips' models; frames of clips without a model are left out."""

    def run(rgb: np.ndarray, a: np.ndarray | None, m: dict) -> dict:
        out, alpha = key_kernel(rgb, m, coverage)
        return {"h": rgb.shape[0], "w": rgb.shape[1], "rgb": out, "a": alpha}

    return P.map_packed(_with_model(frames, models), run, "h int, w int, rgb binary, a binary", ("model",))
