"""Operators over a clip's frames in order.  Clips are bounded, and all share one shuffle by clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framegrid.operators.folds import fold


def by_frame() -> WindowSpec:
    return W.partitionBy("clip_id").orderBy("frame_idx")


def fill_gaps(value: str = "value") -> Column:
    """Missing values from the last one before, else the first one after; stays null if there is none."""
    before = F.last(value, ignorenulls=True).over(by_frame().rowsBetween(W.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(by_frame().rowsBetween(0, W.unboundedFollowing))
    return F.coalesce(before, after)


def rolling_median(value: str, half: int = 7) -> Column:
    """Median of up to ``half`` frames on either side; windows are cut at the ends."""
    return F.percentile(F.col(value), F.lit(0.5)).over(by_frame().rowsBetween(-half, half))


def median_of_three(value: str) -> Column:
    """Median of a frame and its neighbours; the first and last frame stay."""
    a, b, c = F.lag(value).over(by_frame()), F.col(value), F.lead(value).over(by_frame())
    return F.when(a.isNull() | c.isNull(), b).otherwise(F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def collapsed(area: str, ratio: float = 0.6) -> Column:
    """Whether a frame's area is below ``ratio`` of both neighbours'."""
    a, before, after = F.col(area), F.lag(area).over(by_frame()), F.lead(area).over(by_frame())
    return F.coalesce((a < before * ratio) & (a < after * ratio), F.lit(False))


def regions(df: DataFrame, flag: Column, merge: int = 3) -> DataFrame:
    """(clip_id, first, last) of runs of flagged frames; gaps of up to ``merge`` frames are bridged."""
    hit = df.where(flag).select("clip_id", "frame_idx")
    new = (F.col("frame_idx") - F.lag("frame_idx").over(by_frame()) > merge + 1).cast("int")
    run = F.sum(F.coalesce(new, F.lit(0))).over(by_frame())
    return hit.withColumn("run", run).groupBy("clip_id", "run").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")).drop("run")


def hysteresis(df: DataFrame, area: str, hold: int = 5) -> DataFrame:
    """``clip_id, frame_idx, applied``: growth at once, shrinking after ``hold`` requests in a row."""

    def step(state, row):
        (v,) = row
        if state is None or v >= state[0] or state[1] + 1 >= hold:
            return (v, 0), (v,)
        return (state[0], state[1] + 1), (state[0],)

    return fold(df.withColumn(area, F.col(area).cast("double")), ["clip_id"], ["frame_idx"], [area], step, "applied double")


def throttle(df: DataFrame, t: str = "t", stage: str = "stage", done: str = "done", final: str = "final", wait: int = 200, frames: int = 5) -> DataFrame:
    """Ticks published: a new stage, the final tick, ``wait`` ms or ``frames`` frames since the last one published."""

    def step(state, row):
        now, at, n, end = row
        if state is None or at != state[1] or end or now - state[0] >= wait or n - state[2] >= frames:
            return (now, at, n), (now, at)
        return state, None

    ticks = df.select("clip_id", F.col(done).cast("long").alias("done"), F.col(t).cast("long").alias("_t"), F.col(stage).cast("long").alias("_stage"), F.col(final).alias("_final"))
    return fold(ticks, ["clip_id"], ["done"], ["_t", "_stage", "done", "_final"], step, "t long, stage long")


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float = 0.3) -> DataFrame:
    """Last value of a = (1 - rate) a + rate x, started at the first observation."""

    def step(state, row):
        (x,) = row
        state = x if state is None else (1 - rate) * state + rate * x
        return state, (state,)

    run = fold(df, keys, order, [value], step, "_a double")
    return run.groupBy(*keys).agg(F.max_by("_a", F.struct(*order)).alias("value"))


def smoothed_eta(df: DataFrame, raw: str = "raw", share: float = 0.3, jump: float = 1.5) -> DataFrame:
    """``clip_id, tick, remaining``: raw estimates pulled in by ``share`` a tick; a rise counts up to ``jump`` times what was shown."""

    def step(state, row):
        (x,) = row
        x = max(0.0, x)
        state = x if state is None else (1 - share) * state + share * min(x, state * jump)
        return state, (state,)

    return fold(df, ["clip_id"], ["tick"], [raw], step, "remaining double")


def worst(value: str) -> Column:
    """Frame with the greatest value; the first of equals."""
    return F.max_by("frame_idx", F.struct(F.col(value), -F.col("frame_idx")))
