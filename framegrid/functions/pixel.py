"""Pixel algebra as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the keying rules.
T_LO, T_HI = 3.0, 8.0
MAD_SCALE, MAD_FLOOR = 1.4826, 1.0
CHROMA_SHARE = 0.98
# Means and deviations of red, green and blue by which inputs of the matting network are normalised.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MIN_SATURATION = 20.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalised(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Colours of 0..255 as a network's inputs."""
    return tuple((c / 255.0 - m) / d for c, m, d in zip((r, g, b), MEANS, DEVIATIONS))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def cr(r: Column, g: Column, b: Column) -> Column:
    return (r - luma(r, g, b)) * 0.713 + 128.0


def cb(r: Column, g: Column, b: Column) -> Column:
    return (b - luma(r, g, b)) * 0.564 + 128.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation, 0..255."""
    top = F.greatest(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - F.least(r, g, b)) * 255.0 / top)


def hue(r: Column, g: Column, b: Column) -> Column:
    """HSV hue in half degrees, 0..180; 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    base = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(base * 30, F.lit(180.0)))


def hue_gap(a: Column, b: float) -> Column:
    """Difference of two hues around the circle of 180."""
    return F.abs(F.pmod(a - b + 90, F.lit(180.0)) - 90)


def chroma_distance(u: Column, v: Column, mu_u: Column, mu_v: Column, sd_u: Column, sd_v: Column) -> Column:
    du, dv = (u - mu_u) / sd_u, (v - mu_v) / sd_v
    return F.sqrt(du * du + dv * dv)


def ramp(d: Column, low: Column | float, high: Column | float) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return clamp((d - low) / (high - low))


def alpha8(alpha: Column) -> Column:
    """0..255, rounded half to even."""
    return F.rint(alpha * 255).cast("int")


def unmix(c: Column, key: Column, alpha: Column) -> Column:
    """The foreground of a mixed pixel, truncated to 0..255; others stay."""
    mixed = (alpha > 0.004) & (alpha < 0.996)
    exact = F.round((c - (1 - alpha) * key) / F.when(mixed, alpha).otherwise(1.0), 9)
    return F.when(mixed, F.floor(clamp(exact, 0.0, 255.0)).cast("int")).otherwise(c.cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
