"""Numpy kernels on packed frames, for operators that need a pixel's neighbourhood.

Frames are rows, so kernels run where frames are and nothing is shuffled.  Pixels outside a
frame are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framegrid.functions.resample import bilinear

EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def shifted(m: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    out = np.full_like(m, fill)
    h, w = m.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(m: np.ndarray, r: int = 1, times: int = 1) -> np.ndarray:
    for _ in range(times):
        for axis in (0, 1):
            out = m.copy()
            for k in range(1, r + 1):
                for s in (-k, k):
                    out = np.maximum(out, shifted(m, s if axis == 0 else 0, s if axis == 1 else 0, m.min()))
            m = out
    return m


def erode(m: np.ndarray, r: int = 1, times: int = 1) -> np.ndarray:
    if m.dtype == bool:
        return ~dilate(~m, r, times)
    return m.max() - dilate(m.max() - m, r, times)


def components(m: np.ndarray, around=EIGHT) -> np.ndarray:
    """For every pixel of the mask the smallest place (y * w + x) in its component; -1 elsewhere."""
    n = m.size
    label = np.where(m, np.arange(n).reshape(m.shape), n)
    while True:
        low = label
        for dy, dx in around:
            low = np.minimum(low, shifted(label, dy, dx, n))
        low = np.where(m, low, n)
        flat = np.append(low.ravel(), n)
        low = np.where(m, flat[low], n)
        if (low == label).all():
            return np.where(m, label, -1)
        label = low


def holes(m: np.ndarray) -> np.ndarray:
    """Background that the border can't reach by steps along rows and columns."""
    out = ~m
    label = components(out, FOUR)
    edge = np.unique(np.r_[label[0], label[-1], label[:, 0], label[:, -1]])
    return out & ~np.isin(label, edge)


def distance(m: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest pixel of the mask; infinite where it is empty.

    First along columns, then along rows: a pixel looks further to its sides only while that
    can still be nearer, so the cost is the frame times the largest distance.
    """
    if not m.any():
        return np.full(m.shape, np.inf)
    h, w = m.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(m, rows, -4 * (h + w)), axis=0)
    below = np.minimum.accumulate(np.where(m, rows, 5 * (h + w))[::-1], axis=0)[::-1]
    column = np.minimum(rows - above, below - rows).astype(np.int64) ** 2
    best = column.copy()
    for step in range(1, w):
        if step * step >= best.max():
            break
        np.minimum(best[:, step:], column[:, :-step] + step * step, out=best[:, step:])
        np.minimum(best[:, :-step], column[:, step:] + step * step, out=best[:, :-step])
    return np.sqrt(best)


def median3(a: np.ndarray) -> np.ndarray:
    """Median of each pixel and its neighbours within the frame."""
    layers = [a.astype(float)] + [shifted(a.astype(float), dy, dx, np.nan) for dy, dx in EIGHT]
    return np.nanmedian(np.stack(layers), axis=0)


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over the square of side 2r + 1 around each pixel, by running sums."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    wide = total[y1] - total[y0]
    return wide[:, x1] - wide[:, x0]


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    return box_sum(a, r) / box_sum(np.ones(a.shape), r)


def guided(guide: np.ndarray, p: np.ndarray, r: int, eps: float) -> np.ndarray:
    """Guided filter (He et al. 2010) with box means of radius r."""
    mi, mp = box_mean(guide, r), box_mean(p, r)
    a = (box_mean(guide * p, r) - mi * mp) / (box_mean(guide * guide, r) - mi * mi + eps)
    return box_mean(a, r) * guide + box_mean(mp - a * mi, r)


def supersample_threshold(alpha: np.ndarray, factor: int = 4, level: int = 128) -> np.ndarray:
    """Enlarge by linear interpolation, threshold, average back, threshold again."""
    h, w = alpha.shape
    big = bilinear(alpha, h * factor, w * factor) >= level
    return np.where(big.reshape(h, factor, w, factor).mean(axis=(1, 3)) * 255 >= level, 255, 0)


def keep_boxes(boxes: np.ndarray, scores: np.ndarray, overlap: float = 0.45) -> list[int]:
    """Greedy non-maximum suppression whatever the class: places of the boxes kept, best first."""
    left = [int(k) for k in np.lexsort((np.arange(len(scores)), -scores))]
    kept = []
    while left:
        k = left.pop(0)
        kept.append(k)
        a = boxes[k]
        rest = []
        for j in left:
            b = boxes[j]
            inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
            if union <= 0 or inter / union <= overlap:
                rest.append(j)
        left = rest
    return kept


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], dict], fields: str) -> DataFrame:
    """(clip_id, frame_idx, fields): ``kernel`` on every frame's pixels; 2-d results become flat arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [kernel(np.asarray(d, dtype=np.int64).reshape(h, w)) for h, w, d in zip(b["h"], b["w"], b["data"])]
            out = {n: [r[n].ravel().tolist() if isinstance(r[n], np.ndarray) else r[n] for r in rows] for n in [f.split()[0] for f in fields.split(", ")]}
            yield pd.DataFrame({"clip_id": b["clip_id"], "frame_idx": b["frame_idx"], **out})

    return frames.mapInPandas(run, f"clip_id {frames.schema['clip_id'].dataType.simpleString()}, frame_idx int, {fields}")
