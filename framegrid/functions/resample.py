"""Resampling at any ratio and Gaussian blur, one axis after the other."""

from __future__ import annotations

import numpy as np


def _overlap_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the first axis over ``n`` equal stretches, each place counting by its overlap, in units of 1 / n of a place."""
    size = len(x)
    total = np.concatenate((np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, axis=0))) * n
    at = np.arange(n + 1) * size
    whole, part = at // n, at % n
    upto = total[whole] + np.concatenate((x, x[-1:]))[whole] * part.reshape(-1, *[1] * (x.ndim - 1))
    return np.diff(upto, axis=0)


def area(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """``x`` (two or three axes) at h x w, each place the mean of what it covers; whole numbers stay exact, a half goes to the even one."""
    whole = np.issubdtype(x.dtype, np.integer)
    s = _overlap_sums(x.astype(np.int64 if whole else np.float64), h)
    s = np.swapaxes(_overlap_sums(np.swapaxes(s, 0, 1), w), 0, 1)
    d = x.shape[0] * x.shape[1]
    if not whole:
        return s / d
    q, rest = s // d, s % d
    return (q + ((2 * rest > d) | ((2 * rest == d) & (q % 2 == 1)))).astype(x.dtype)


def _linear(x: np.ndarray, n: int) -> np.ndarray:
    at = np.clip((np.arange(n) + 0.5) * len(x) / n - 0.5, 0, len(x) - 1)
    low = np.minimum(at.astype(int), max(0, len(x) - 2))
    share = (at - low).reshape(-1, *[1] * (x.ndim - 1))
    return x[low] * (1 - share) + x[np.minimum(low + 1, len(x) - 1)] * share


def bilinear(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """``x`` at h x w by linear interpolation between the centres of places; beyond the outermost centres the value stays."""
    return np.swapaxes(_linear(np.swapaxes(_linear(x.astype(np.float64), h), 0, 1), w), 0, 1)


def lanczos(x: np.ndarray, h: int, w: int, lobes: int = 3) -> np.ndarray:
    """``x`` enlarged to h x w by windowed sinc weights; beyond the outermost centres the outermost places stand."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        at = (np.arange(n) + 0.5) * len(x) / n - 0.5
        first = np.floor(at).astype(int) - lobes + 1
        out, total = 0.0, 0.0
        for k in range(2 * lobes):
            d = at - (first + k)
            weight = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
            out = out + x[np.clip(first + k, 0, len(x) - 1)] * weight.reshape(-1, *[1] * (x.ndim - 1))
            total = total + weight
        return out / total.reshape(-1, *[1] * (x.ndim - 1))

    return np.swapaxes(along(np.swapaxes(along(x.astype(np.float64), h), 0, 1), w), 0, 1)


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """``x`` at h x w in its own kind: means where it gets smaller, else interpolated."""
    if x.shape[:2] == (h, w):
        return x
    if h <= x.shape[0] and w <= x.shape[1]:
        return area(x, h, w)
    out = bilinear(x, h, w)
    return np.rint(out).astype(x.dtype) if np.issubdtype(x.dtype, np.integer) else out


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Blur by a Gaussian cut at four deviations; the frame is mirrored about its outermost places."""
    r = max(1, int(np.rint(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = x.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect" if out.shape[axis] > 1 else "edge")
        n = out.shape[axis]
        out = sum(v * np.take(wide, np.arange(i, i + n), axis=axis) for i, v in enumerate(k))
    return out


def crop_to(x: np.ndarray, side: int, pad: int) -> tuple[np.ndarray, float]:
    """``x`` fitted into a square of ``side`` at its upper left, filled up with ``pad``, and the factor of its size."""
    factor = side / max(x.shape[:2])
    h, w = (max(1, int(n * factor)) for n in x.shape[:2])
    out = np.full((side, side, *x.shape[2:]), pad, x.dtype)
    out[:h, :w] = np.rint(bilinear(x, h, w)).astype(x.dtype)
    return out, factor
