"""Queries over files that Spark writes from the tables and reads again, each beside its SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.operators import gif, matte
from framegrid.operators.store import shared_folder
from framegrid.plans import sql
from framegrid.plans.matte import plain
from framegrid.plans.queries import query
from framegrid.sources.frame_files import read_frames, write_frames


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(frames):
    """Long pixels of frames whose clips are named by numbers."""
    return P.unpack(frames, {"a": 1, "rgb": 3}).withColumn("clip_id", F.col("clip_id").cast("int"))


@query(sql.GRID + "select clip_id, frame_idx, y, x, a, r, g, b from px")
def src_frame_files(spark, d):
    """Frames written as raw files, a file a clip, and read by ranges of frames."""
    path = new_folder(spark, "raw")
    write_frames(plain(spark, d), path)
    return numbered(read_frames(spark, path, bytes=2048))


@query(sql.GRID + "select clip_id, frame_idx, y, x, a, r, g, b from px where clip_id in (1, 3, 4) and frame_idx >= 5 and frame_idx < 40")
def src_frame_ranges(spark, d):
    """Of the files only the clips and frames are read that are asked for."""
    path = new_folder(spark, "raw")
    write_frames(plain(spark, d), path)
    return numbered(read_frames(spark, path, bytes=2048, clips=["1", "3", "4"], first=5, last=39))


@query(sql.GRID + "select clip_id, frame_idx, y, x, case when a >= 128 then 255 else 0 end as a, case when a >= 128 then r // 64 * 85 else 0 end as r, case when a >= 128 then g // 64 * 85 else 0 end as g, case when a >= 128 then b // 64 * 85 else 0 end as b from px")
def snk_gif(spark, d):
    """Frames of 64 colours written as transparent GIFs by the clips' palettes, and decoded."""
    path = new_folder(spark, "gif")
    few = P.map_packed(plain(spark, d), lambda rgb, a: {"h": a.shape[0], "w": a.shape[1], "rgb": rgb // 64 * 85, "a": a}, matte.FRAME)
    gif.write_gifs(few, path)
    return numbered(gif.read_gifs(spark, path))


@query(sql.GRID + """select clip_id, frame_idx, count(*) filter (a >= 128) as visible, 0::bigint as apart from px group by all""")
def snk_gif_colourful(spark, d):
    """Frames of many colours as GIFs: visible pixels, and those whose colour isn't the nearest of their clip's palette."""
    path = new_folder(spark, "gif")
    frames = plain(spark, d)
    gif.write_gifs(frames, path)
    held = gif.read_gifs(spark, path).select(F.col("clip_id").cast("int").alias("clip_id"), "frame_idx", F.col("rgb").alias("out"), F.col("a").alias("seen"))
    both = P.with_clip(frames.join(held, ["clip_id", "frame_idx"]), gif.palettes(frames))

    def run(rgb: np.ndarray, a: np.ndarray, out: bytes, seen: bytes, palette: bytes) -> dict:
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3).astype(np.int64)
        shown, on = np.frombuffer(out, np.uint8).reshape(rgb.shape), np.frombuffer(seen, np.uint8).reshape(a.shape) > 0
        best = ((rgb[:, :, None] - colours) ** 2).sum(axis=3).min(axis=2)
        own = ((rgb.astype(np.int64) - shown) ** 2).sum(axis=2)
        return {"visible": int(on.sum()), "apart": int((on & (own != best)).sum())}

    return P.map_packed(both, run, "visible long, apart long", ("out", "seen", "palette"))
