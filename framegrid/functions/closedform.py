"""Closed-form matting (Levin, Lischinski and Weiss, "A Closed-Form Solution to Natural Image Matting", 2008).

The matting Laplacian is never built: what it makes of a plane follows from the best local linear
models of that plane in the colours of each window, which are sums over windows (He, Sun and Tang,
"Fast Matting Using Large Kernel Matting Laplacian Matrices", 2010).  Conjugate gradients solve for
alpha with the sure pixels held.
"""

from __future__ import annotations

import numpy as np

from framegrid.functions import kernels as K
from framegrid.functions import packed as P
from framegrid.functions.resample import bilinear

#: Largest side of the crop that is solved; larger ones are solved smaller and enlarged.
CAP = 512
#: Alphas that are sure, the padding of the subject's box, the width of the band, the fewest pixels of a subject.
SURE, PAD, BAND, LEAST = 0.05, 8, 7, 50


class Laplacian:
    """The matting Laplacian of an image of three channels of 0..1, by windows of side 2r + 1."""

    def __init__(self, image: np.ndarray, r: int = 1, eps: float = 1e-7):
        self.image, self.r = image, r
        self.n = K.box_sum(np.ones(image.shape[:2]), r)
        self.mean = np.stack([K.box_sum(image[..., c], r) for c in range(3)], axis=2) / self.n[..., None]
        cov = np.empty((*image.shape[:2], 3, 3))
        for i in range(3):
            for j in range(i, 3):
                cov[..., i, j] = cov[..., j, i] = K.box_sum(image[..., i] * image[..., j], r) / self.n - self.mean[..., i] * self.mean[..., j]
        self.inverse = np.linalg.inv(cov + np.eye(3) * (eps / self.n)[..., None, None])

    def __call__(self, p: np.ndarray) -> np.ndarray:
        mean = K.box_sum(p, self.r) / self.n
        with_p = np.stack([K.box_sum(self.image[..., c] * p, self.r) for c in range(3)], axis=2) / self.n[..., None]
        a = np.einsum("yxij,yxj->yxi", self.inverse, with_p - self.mean * mean[..., None])
        b = mean - (a * self.mean).sum(axis=2)
        model = sum(K.box_sum(a[..., c], self.r) * self.image[..., c] for c in range(3)) + K.box_sum(b, self.r)
        return self.n * p - model


def solve(image: np.ndarray, given: np.ndarray, sure: np.ndarray, weight: float = 100.0, steps: int = 2000, close: float = 1e-5) -> np.ndarray:
    """Alpha that the image's colours explain best, held to ``given`` where it is ``sure``; not solved closely enough is an error."""
    laplacian, hold = Laplacian(image), weight * sure
    matrix = lambda p: laplacian(p) + hold * p
    scale = 1 / (laplacian.n + hold)
    x = given.astype(np.float64).copy()
    rest = hold * given - matrix(x)
    target = close * max(np.linalg.norm(hold * given), 1e-12)
    z = scale * rest
    along, size = z, (rest * z).sum()
    for _ in range(steps):
        if np.linalg.norm(rest) <= target:
            return np.clip(x, 0, 1)
        ahead = matrix(along)
        step = size / (along * ahead).sum()
        x, rest = x + step * along, rest - step * ahead
        z = scale * rest
        new = (rest * z).sum()
        along, size = z + new / size * along, new
    raise ArithmeticError(f"not solved in {steps} steps")


def refined(rgb: np.ndarray, alpha: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """``alpha`` of 0..1 with the soft band of the subject solved anew from the colours; as it was where that fails or there is hardly a subject."""
    ys, xs = np.nonzero(alpha > SURE)
    if len(xs) < LEAST:
        return alpha
    pad = max(1, round(PAD * scale))
    box = (slice(max(0, ys.min() - pad), ys.max() + pad), slice(max(0, xs.min() - pad), xs.max() + pad))
    own, image = alpha[box], rgb[box] / 255.0
    h, w = own.shape
    share = min(1.0, CAP / max(h, w))
    if share < 1:
        small = (max(1, int(h * share)), max(1, int(w * share)))
        own, image = bilinear(own, *small), bilinear(image, *small)
    k = max(1, round(BAND * scale)) | 1
    soft = P.spread((own > SURE) & (own < 1 - SURE), P.square(k // 2))
    try:
        solved = solve(image, np.where(own > 1 - SURE, 1.0, np.where(own < SURE, 0.0, 0.5)), ~soft & ((own > 1 - SURE) | (own < SURE)))
    except (ArithmeticError, np.linalg.LinAlgError):
        return alpha
    if not np.isfinite(solved).all():
        return alpha
    out = alpha.astype(np.float64).copy()
    out[box] = bilinear(solved, h, w) if share < 1 else solved
    return out
