"""Dense optical flow by block matching on a pyramid, and warping along it."""

from __future__ import annotations

import numpy as np

from framegrid.functions import kernels as K
from framegrid.functions.resample import area, bilinear

#: A pyramid's coarsest level has sides of at least so many pixels.
COARSEST = 16


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma as whole numbers."""
    x = rgb.astype(np.int64)
    return (299 * x[..., 0] + 587 * x[..., 1] + 114 * x[..., 2] + 500) // 1000


def _apart(a: np.ndarray, b: np.ndarray, dy: np.ndarray, dx: np.ndarray, radius: int) -> np.ndarray:
    """Squared differences between a and b displaced, summed over the window around each pixel; places are held within the frame."""
    h, w = a.shape
    y = np.clip(np.arange(h)[:, None] + dy, 0, h - 1)
    x = np.clip(np.arange(w)[None, :] + dx, 0, w - 1)
    return K.box_sum((a - b[y, x]) ** 2, radius)


def search(a: np.ndarray, b: np.ndarray, base: np.ndarray, reach: int, radius: int) -> np.ndarray:
    """Whole displacements (dy, dx) within ``reach`` of ``base`` at which b looks most like a; of equals the nearest to the base, then the upper, then the left one."""
    steps = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))
    best, out = np.full(a.shape, np.inf), base.copy()
    for dy, dx in steps:
        cost = _apart(a, b, base[..., 0] + dy, base[..., 1] + dx, radius)
        better = cost < best
        best[better] = cost[better]
        out[better] = base[better] + (dy, dx)
    return out


def refined(a: np.ndarray, b: np.ndarray, whole: np.ndarray, radius: int) -> np.ndarray:
    """Displacements moved by up to half a pixel to the lowest point of the parabola through a place and its neighbours; what fits wholly stays."""
    out = whole.astype(np.float64)
    here = _apart(a, b, whole[..., 0], whole[..., 1], radius)
    for axis in (0, 1):
        step = np.array([1, 0]) if axis == 0 else np.array([0, 1])
        low, high = (_apart(a, b, whole[..., 0] + s * step[0], whole[..., 1] + s * step[1], radius) for s in (-1, 1))
        bend = low - 2 * here + high
        move = np.where((bend > 0) & (here > 0), 0.5 * (low - high) / np.where(bend > 0, bend, 1), 0.0)
        out[..., axis] += np.clip(move, -0.5, 0.5)
    return out


def steady(found: np.ndarray) -> np.ndarray:
    """Whole displacements by the median of a pixel and its neighbours."""
    return np.stack([np.rint(K.median3(found[..., c])).astype(np.int64) for c in (0, 1)], axis=2)


def flow(a: np.ndarray, b: np.ndarray, levels: int | None = None, reach: int = 2, radius: int = 2, fine: bool = True) -> np.ndarray:
    """(h, w, 2): where each pixel of the grey frame ``a`` is in ``b``, as (dy, dx).

    Displacements are searched within ``reach`` on the coarsest of ``levels`` (None: as many as
    the frame allows) and corrected on each finer one.  With several levels outliers give way to
    the median of their neighbours; without ``fine`` displacements are whole.
    """
    a, b = a.astype(np.float64), b.astype(np.float64)
    stack = [(a, b)]
    while (levels is None or len(stack) < levels) and min(stack[-1][0].shape) >= 2 * COARSEST:
        h, w = ((n + 1) // 2 for n in stack[-1][0].shape)
        stack.append(tuple(area(x, h, w) for x in stack[-1]))
    found = np.zeros((*stack[-1][0].shape, 2), np.int64)
    for k, (x, y) in enumerate(reversed(stack)):
        if k:
            scale = np.array([x.shape[0] / found.shape[0], x.shape[1] / found.shape[1]])
            found = np.rint(bilinear(found, *x.shape) * scale).astype(np.int64)
        found = search(x, y, found, reach, radius)
        if len(stack) > 1:  # windows are compared truly where the displacements in them agree
            for _ in range(2):
                found = search(x, y, steady(found), 1, radius)
            found = steady(found)
    return refined(a, b, found, radius) if fine else found


def flow_between(x: np.ndarray, y: np.ndarray, scale: float = 1.0, **search) -> np.ndarray:
    """Flow from the grey frame x to y; with ``scale`` below 1 it is found on smaller frames and enlarged."""
    if scale >= 1:
        return flow(x, y, **search)
    h, w = (max(8, int(np.rint(n * scale))) for n in x.shape)
    small = flow(area(x, h, w), area(y, h, w), **search)
    return bilinear(small, *x.shape) * np.array([x.shape[0] / h, x.shape[1] / w])


def warp(x: np.ndarray, along: np.ndarray, nearest: bool = False) -> np.ndarray:
    """``x`` taken where ``along`` leads from each pixel, between pixels linearly or from the nearest; places are held within the frame."""
    h, w = x.shape[:2]
    y = np.clip(np.arange(h)[:, None] + along[..., 0], 0, h - 1)
    c = np.clip(np.arange(w)[None, :] + along[..., 1], 0, w - 1)
    if nearest:
        return x[np.rint(y).astype(int), np.rint(c).astype(int)]
    y0, c0 = np.floor(y).astype(int), np.floor(c).astype(int)
    y1, c1 = np.minimum(y0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    v, u = y - y0, c - c0
    return (x[y0, c0] * (1 - v) * (1 - u) + x[y0, c1] * (1 - v) * u) + (x[y1, c0] * v * (1 - u) + x[y1, c1] * v * u)
