"""Robust statistics of backdrops and the keying model made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions.pixel import CHROMA_SHARE, MAD_FLOOR, MAD_SCALE, MIN_SATURATION, chroma_distance
from framegrid.operators.store import written


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], n: Column | None = None) -> DataFrame:
    """(clip_id, one column per name): the percentile of each name's value over a clip's rows, which count ``n`` times.

    Equal values are counted before a clip's come together, so a task reads a clip's different
    values once, however many rows the clip has.  Null values are left out.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), x.cast("double").alias("x")) for name, (x, _) in wanted.items())))
    counted = df.select("clip_id", (F.lit(1) if n is None else n).cast("long").alias("n"), each.alias("_v")).groupBy("clip_id", "_v.name", "_v.x").agg(F.sum("n").alias("n"))
    return counted.groupBy("clip_id").agg(*(F.percentile(F.when(F.col("name") == name, F.col("x")), F.lit(p), F.col("n")).alias(name) for name, (_, p) in wanted.items()))


def _spread(df: DataFrame) -> DataFrame:
    """(clip_id, mu_u, mu_v, sd_u, sd_v) of counted values."""
    n = F.col("n")
    middle = percentiles(df, {"mu_u": (F.col("u"), 0.5), "mu_v": (F.col("v"), 0.5)}, n)
    off = {f"sd_{c}": (F.abs(F.col(c) - F.col(f"mu_{c}")), 0.5) for c in ("u", "v")}
    mads = percentiles(df.join(middle, "clip_id"), off, n)
    return middle.join(mads.select("clip_id", *(F.greatest(F.col(c) * MAD_SCALE, F.lit(MAD_FLOOR)).alias(c) for c in off)), "clip_id")


def sigma_clip(ring: DataFrame, u: str = "u", v: str = "v", keep: float = 5.0, n: Column | None = None) -> DataFrame:
    """(clip_id, mu_u, mu_v, sd_u, sd_v, share, flat) of a clip's border pixels, each ``n`` times.

    Medians and scaled median deviations of all, then of those within ``keep`` deviations;
    ``share`` is the part of all pixels within 8 deviations at the end, flat if above 98 %.
    Pixels of equal chroma are counted once at the start, so all that follows grows with a
    clip's different chromas, not with its frames.
    """
    d = chroma_distance(F.col("u"), F.col("v"), F.col("mu_u"), F.col("mu_v"), F.col("sd_u"), F.col("sd_v"))
    counted = written(ring.groupBy("clip_id", F.col(u).alias("u"), F.col(v).alias("v")).agg(F.sum(F.lit(1) if n is None else n).alias("n")))
    first = written(_spread(counted))
    model = written(_spread(counted.join(first, "clip_id").where(d < keep).select(*counted.columns)))
    near, all_ = F.sum(F.when(d < 8, F.col("n")).otherwise(0)), F.sum(F.when(d.isNotNull(), F.col("n")))
    share = counted.join(model, "clip_id").groupBy("clip_id").agg((near / all_).alias("share"))
    return model.join(share, "clip_id").withColumn("flat", F.col("share") > CHROMA_SHARE)


def key_model(stats: DataFrame, slope: float = 0.5, measured: Column | None = None) -> DataFrame:
    """Adds saturation, neutral, t_lo, t_hi and safe to backdrop statistics (u is Cb, v is Cr)."""
    saturation = F.hypot(F.col("mu_u") - 128, F.col("mu_v") - 128)
    neutral = chroma_distance(F.lit(128.0), F.lit(128.0), F.col("mu_u"), F.col("mu_v"), F.col("sd_u"), F.col("sd_v"))
    high = F.greatest(F.lit(4.0), neutral * slope)
    low = F.lit(3.0) if measured is None else F.least(F.greatest(F.lit(3.0), F.coalesce(measured, F.lit(3.0))), F.greatest(F.lit(3.0), high / 2))
    out = stats.withColumns({"saturation": saturation, "neutral": neutral, "t_lo": low})
    return out.withColumns({"t_hi": F.greatest(F.col("t_lo") + 1, high), "safe": F.col("flat") & (F.col("saturation") >= MIN_SATURATION)})
