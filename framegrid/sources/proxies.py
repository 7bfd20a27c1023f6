"""Clip, frame, track and job views over the test tables, which hold no video.

An embedding is a frame of 8 x 8 pixels, a user's events are a clip's track of one measure, an
order is a job and its line items are the job's clips.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, frame_idx, h, w, data): one row per frame, ``data`` its pixels row by row, 0..255."""
    level = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") * 2 + 0.5) * 255))).cast("int"))
    order = W.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame_idx"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), level.alias("data"))


def pixels(packed: DataFrame) -> DataFrame:
    """The long form of frames: (clip_id, frame_idx, y, x, a)."""
    cells = packed.select("clip_id", "frame_idx", "w", F.posexplode("data").alias("p", "a"))
    return cells.select("clip_id", "frame_idx", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), "a")


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, frame_idx, y, x, a, r, g, b): green and blue are the pixels 21 and 42 places on, around the frame."""
    f = frames(spark, sf_dir)
    n = SIDE * SIDE
    cells = f.select("clip_id", "frame_idx", "data", F.posexplode("data").alias("p", "a"))
    at = lambda k: F.element_at("data", ((F.col("p") + k) % n + 1).cast("int"))
    return cells.select("clip_id", "frame_idx", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), "a", F.col("a").alias("r"), at(21).alias("g"), at(42).alias("b"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed frames (clip_id, frame_idx, h, w, rgb, a) with a flat backdrop around a subject in the middle.

    ``a`` is the matte to be judged.  Every fifth clip has no backdrop.
    """

    def paint(batches):
        p = np.arange(SIDE * SIDE)
        middle = (np.abs(p // SIDE - 3.5) < 2) & (np.abs(p % SIDE - 3.5) < 2)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a = np.array(batch.column("data").to_pylist(), dtype=np.int64)
                clip = batch.column("clip_id").to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
                rgb = np.stack((a, np.roll(a, -21, axis=1), np.roll(a, -42, axis=1)), axis=2)
                back = np.stack((40 + clip * 3 + a % 3, 180 + a % 5 + 20 * (a % 83 == 7), 60 + a % 4), axis=2)
                flat = (clip % 5 > 0) & ~(middle[None, :] & (a >= 90))
                rgb = np.where(flat[:, :, None], back, rgb).astype(np.uint8)
                both = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (rgb, a.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("clip_id", "frame_idx", "h", "w")), *both], names=["clip_id", "frame_idx", "h", "w", "rgb", "a"])

    f = frames(spark, sf_dir)
    return f.mapInArrow(paint, f"clip_id {f.schema['clip_id'].dataType.simpleString()}, frame_idx int, h int, w int, rgb binary, a binary")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, frame_idx, value): null where the measure is missing."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame_idx"), value.alias("value"), "event_type", "event_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, status, created_at, priority, price)."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, clip_no, status, frames, work, part): a job's clips by position."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    status = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "N", "pending").otherwise("failed")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.row_number().over(order) - 1).alias("clip_no"), status.alias("status"), F.col("l_quantity").cast("int").alias("frames"), F.col("l_extendedprice").alias("work"), F.col("l_partkey").alias("part"), F.col("l_discount").alias("fraction"))
