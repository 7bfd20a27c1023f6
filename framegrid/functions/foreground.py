"""Foreground colours of a matte by multi-level estimation (Germer, Uelwer, Conrad, Harmeling: "Fast Multi-Level Foreground Estimation", 2020)."""

from __future__ import annotations

import numpy as np

#: Regularisation, weight of alpha's gradient, iterations on small and on large levels, and the side up to which a level is small.
REGULAR, GRADIENT, SMALL_STEPS, LARGE_STEPS, SMALL_SIDE = 1e-5, 1.0, 10, 2, 32
#: Alphas between these are mixed; a subject of fewer pixels than the last number is left alone.
BAND, LEAST = (0.02, 0.98), 50


def _nearest(x: np.ndarray, h: int, w: int) -> np.ndarray:
    return x[np.minimum(np.arange(h) * x.shape[0] // h, x.shape[0] - 1)][:, np.minimum(np.arange(w) * x.shape[1] // w, x.shape[1] - 1)]


def _beside(x: np.ndarray) -> list[np.ndarray]:
    """The four neighbours of every pixel; at the edges the pixel itself."""
    return [np.concatenate((x[:1], x[:-1])), np.concatenate((x[1:], x[-1:])), np.concatenate((x[:, :1], x[:, :-1]), axis=1), np.concatenate((x[:, 1:], x[:, -1:]), axis=1)]


def foreground(image: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """F of image = alpha F + (1 - alpha) B, all 0..1, smooth where alpha is; coarse levels first.

    On each level every pixel's F and B solve a two by two system with those of its neighbours as
    they were in the step before.
    """
    h, w = alpha.shape
    mean = lambda m: image[m].mean(axis=0) if m.any() else np.zeros(3)
    f, b = mean(alpha > 0.9).reshape(1, 1, 3), mean(alpha < 0.1).reshape(1, 1, 3)
    levels = max(1, int(np.ceil(np.log2(max(h, w)))))
    for level in range(levels + 1):
        lh, lw = max(1, round(h ** (level / levels))), max(1, round(w ** (level / levels)))
        i, a = _nearest(image, lh, lw), _nearest(alpha, lh, lw)
        f, b = _nearest(f, lh, lw), _nearest(b, lh, lw)
        rest = 1 - a
        weights = [REGULAR + GRADIENT * np.abs(a - x) for x in _beside(a)]
        total = sum(weights)
        ff, fb, bb = a * a + total, a * rest, rest * rest + total
        det = ff * bb - fb * fb
        for _ in range(SMALL_STEPS if max(lh, lw) <= SMALL_SIDE else LARGE_STEPS):
            to_f = a[..., None] * i + sum(k[..., None] * x for k, x in zip(weights, _beside(f)))
            to_b = rest[..., None] * i + sum(k[..., None] * x for k, x in zip(weights, _beside(b)))
            f = np.clip((bb[..., None] * to_f - fb[..., None] * to_b) / det[..., None], 0, 1)
            b = np.clip((ff[..., None] * to_b - fb[..., None] * to_f) / det[..., None], 0, 1)
    return f


def despill(rgb: np.ndarray, a: np.ndarray, band_only: bool = True, pad: int = 8) -> np.ndarray:
    """Colours without the backdrop's share, in the box around the subject; ``band_only`` leaves all but the mixed pixels as they are."""
    alpha = a / 255.0
    ys, xs = np.nonzero(alpha > BAND[0])
    if len(ys) < LEAST:
        return rgb
    part = (slice(max(0, ys.min() - pad), ys.max() + pad), slice(max(0, xs.min() - pad), xs.max() + pad))
    band = (alpha[part] > BAND[0]) & (alpha[part] < BAND[1])
    if band_only and not band.any():
        return rgb
    new = np.clip(foreground(rgb[part] / 255.0, alpha[part]) * 255, 0, 255).astype(np.uint8)
    out = rgb.copy()
    out[part] = np.where(band[..., None], new, rgb[part]) if band_only else new
    return out
