"""Matte-quality metrics on the long form: (clip_id, frame_idx, y, x, a, ...)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.operators.temporal import by_frame, worst

#: Fixed: alpha from which a pixel is opaque, and a jump of colour.
OPAQUE, JUMP = 127, 8


def by_pixel() -> WindowSpec:
    return W.partitionBy("clip_id", "y", "x").orderBy("frame_idx")


def per_frame(df: DataFrame, flag: Column, name: str = "n") -> DataFrame:
    return df.groupBy("clip_id", "frame_idx").agg(F.sum(flag.cast("long")).alias(name))


def roll_up(frames: DataFrame, value: str = "n") -> DataFrame:
    """(clip_id, total, worst_frame, worst_value, mean); the first of equally bad frames."""
    return frames.groupBy("clip_id").agg(F.sum(value).alias("total"), worst(value).alias("worst_frame"), F.max(value).alias("worst_value"), F.round(F.avg(value), 6).alias("mean"))


def false_erase(df: DataFrame) -> DataFrame:
    return roll_up(per_frame(df, (F.col("d") > 8) & (F.col("a") < OPAQUE)))


def false_keep(df: DataFrame) -> DataFrame:
    return roll_up(per_frame(df, (F.col("d") < 3) & (F.col("a") >= OPAQUE)))


def flicker(df: DataFrame, still: float = 1.0) -> DataFrame:
    """Pixels opaque in both of two frames whose colour jumps though the source there hardly changes on average."""
    step = df.withColumns({"pa": F.lag("a").over(by_pixel()), "jump": F.abs(F.col("r") - F.lag("r").over(by_pixel())), "moved": F.abs(F.col("g") - F.lag("g").over(by_pixel()))}).where("pa is not null")
    static = F.avg("moved").over(W.partitionBy("clip_id", "y", "x")) < still
    return roll_up(per_frame(step.withColumn("static", static), (F.col("a") > OPAQUE) & (F.col("pa") > OPAQUE) & (F.col("jump") > JUMP) & F.col("static")))


def frozen(df: DataFrame, channels: tuple[str, ...] = ("r",)) -> DataFrame:
    """(clip_id, n, x0, y0, x1, y1) of pixels that never change in any of ``channels`` and are always opaque."""
    still = reduce(and_, (F.min(c) == F.max(c) for c in channels))
    same = df.groupBy("clip_id", "y", "x").agg(still.alias("s"), F.bool_and(F.col("a") > OPAQUE).alias("o"))
    hit = F.col("s") & F.col("o")
    return same.groupBy("clip_id").agg(F.count_if(hit).alias("n"), *(f(F.when(hit, F.col(c))).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))))


def area_jump(df: DataFrame) -> DataFrame:
    """(clip_id, worst_frame, worst_jump, mean_jump) of opaque area relative to the frame before."""
    out = area_jump_of(per_frame(df, F.col("a") > OPAQUE, "area"))
    return out.select("clip_id", F.col("s4_worst_frame").alias("worst_frame"), F.col("s4_worst").alias("worst_jump"), F.col("s4_mean").alias("mean_jump"))


def area_jump_of(area: DataFrame) -> DataFrame:
    """(clip_id, s4_worst_frame, s4_worst, s4_mean) from (clip_id, frame_idx, area)."""
    before = F.lag("area").over(by_frame())
    jumps = area.withColumn("jump", F.round(F.abs(F.col("area") - before) / F.greatest(before, F.lit(1)), 6)).where("jump is not null")
    return jumps.groupBy("clip_id").agg(worst("jump").alias("s4_worst_frame"), F.max("jump").alias("s4_worst"), F.round(F.avg("jump"), 6).alias("s4_mean"))


def soft_sad(df: DataFrame, other: DataFrame) -> DataFrame:
    """Mean absolute difference of alpha between two runs, pixel by pixel; frames in both."""
    keys = ["clip_id", "frame_idx", "y", "x"]
    both = df.select(*keys, "a").join(other.select(*keys, F.col("a").alias("o")), keys)
    return both.groupBy("clip_id").agg(F.round(F.avg(F.abs(F.col("a") - F.col("o")) / 255.0), 6).alias("sad"))


def alpha_flips(df: DataFrame, other: DataFrame, level: int = 128) -> DataFrame:
    """(clip_id, flips, percent, max_delta): pixels that cross ``level`` between two runs."""
    keys = ["clip_id", "frame_idx", "y", "x"]
    both = df.select(*keys, "a").join(other.select(*keys, F.col("a").alias("o")), keys)
    flip = (F.col("a") >= level) != (F.col("o") >= level)
    return both.groupBy("clip_id").agg(F.count_if(flip).alias("flips"), F.round(100.0 * F.count_if(flip) / F.count("*"), 6).alias("percent"), F.max(F.abs(F.col("a") - F.col("o"))).alias("max_delta"))


def compare(a: DataFrame, b: DataFrame, key: str, metrics: list[str], higher_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(key, metric, before, after, delta, verdict) for keys that both runs have."""
    long = lambda df, n: df.select(key, *(F.col(m).cast("double") for m in metrics)).unpivot(key, metrics, "metric", n)
    both = long(a, "before").join(long(b, "after"), [key, "metric"]).withColumn("delta", F.round(F.col("after") - F.col("before"), 6))
    up = F.col("metric").isin(list(higher_is_better)) if higher_is_better else F.lit(False)
    good = F.when(up, F.col("delta") > 0).otherwise(F.col("delta") < 0)
    return both.withColumn("verdict", F.when(F.col("delta") == 0, "same").when(good, "better").when(F.col("delta").isNotNull(), "worse"))
