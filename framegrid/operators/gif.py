"""Clips as GIFs: a palette per clip from counted colours, frames encoded where they are, files written whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions import gif as G
from framegrid.functions import packed as P
from framegrid.functions.kernels import supersample_threshold
from framegrid.functions.resample import area, lanczos
from framegrid.operators.store import written
from framegrid.sources.frame_files import FRAMES, write_frames

#: Alpha from which a pixel is visible, by default, and bits of a channel that tell the colours of colourful clips apart.
VISIBLE, BITS = 128, 5
#: Different colours that a task counts before it hands them on.
HELD = 1 << 18


def colour_counts(frames: DataFrame, visible: int = VISIBLE) -> DataFrame:
    """(clip_id, colour, n) of the visible pixels, counted in the tasks first."""
    clip = frames.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            for clip_id, parts in held.items():
                colours, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([clip_id] * len(colours), kind), pa.array(colours.astype(np.int32)), pa.array(n)], names=["clip_id", "colour", "n"])
            held.clear()

        count, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("clip_id").type
            for k in range(batch.num_rows):
                rgb = np.frombuffer(batch.column("rgb")[k].as_py(), np.uint8).reshape(-1, 3)
                if batch.column("a")[k].is_valid:
                    rgb = rgb[np.frombuffer(batch.column("a")[k].as_py(), np.uint8) >= visible]
                colours, n = np.unique(rgb.astype(np.int64) @ (65536, 256, 1), return_counts=True)
                held.setdefault(batch.column("clip_id")[k].as_py(), []).append((colours, n))
                count += len(colours)
                if count > HELD:
                    yield from out(kind)
                    count = 0
        yield from out(kind)

    counted = frames.select("clip_id", "rgb", "a").mapInArrow(run, f"clip_id {clip}, colour int, n long")
    return counted.groupBy("clip_id", "colour").agg(F.sum("n").alias("n"))


def palettes(frames: DataFrame, visible: int = VISIBLE, size: int = G.COLOURS) -> DataFrame:
    """(clip_id, palette): every clip's colours where they are at most ``size``, else those of a median cut.

    A colourful clip's colours are first brought together by their upper bits, so that a cut works
    on at most 2^15 of them however long the clip is.  A clip without a visible pixel has black alone.
    """
    counts = written(colour_counts(frames, visible))
    few = counts.groupBy("clip_id").agg(F.count("*").alias("_n"))
    r, g, b = (F.shiftright("colour", k).bitwiseAND(255) for k in (16, 8, 0))
    upper = F.concat_ws(",", *(F.shiftright(c, 8 - BITS).cast("string") for c in (r, g, b)))
    held = counts.join(few, "clip_id").withColumn("bin", F.when(F.col("_n") <= size, F.col("colour").cast("string")).otherwise(upper))
    bins = held.groupBy("clip_id", "bin").agg(F.sum("n").alias("n"), *((F.sum(c * F.col("n")) / F.sum("n")).alias(name) for c, name in ((r, "r"), (g, "g"), (b, "b"))))
    clip = frames.schema["clip_id"].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        colours = np.rint(rows[["r", "g", "b"]].to_numpy()).astype(np.int64)
        order = np.lexsort(colours.T[::-1])
        return pd.DataFrame({"clip_id": [rows["clip_id"].iloc[0]], "palette": [G.median_cut(colours[order], rows["n"].to_numpy()[order], size).tobytes()]})

    made = bins.groupBy("clip_id").applyInPandas(cut, f"clip_id {clip}, palette binary")
    return frames.select("clip_id").distinct().join(made, "clip_id", "left").withColumn("palette", F.coalesce("palette", F.lit(b"\0\0\0")))


def _index(rgb: np.ndarray, a: np.ndarray | None, palette: bytes, visible: int) -> np.ndarray:
    index = G.nearest(rgb, np.frombuffer(palette, np.uint8).reshape(-1, 3))
    return index if a is None else np.where(a >= visible, index, G.CLEAR).astype(np.uint8)


def quantised(frames: DataFrame, palettes: DataFrame, visible: int = VISIBLE) -> DataFrame:
    """``frames`` in the colours of their clip's palette, alpha all or nothing."""

    def run(rgb: np.ndarray, a: np.ndarray | None, palette: bytes) -> dict:
        index = _index(rgb, a, palette, visible)
        colours = np.zeros((256, 3), np.uint8)
        colours[: len(palette) // 3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        return {"h": rgb.shape[0], "w": rgb.shape[1], "rgb": colours[index], "a": np.where(index == G.CLEAR, 0, 255).astype(np.uint8)}

    return P.map_packed(P.with_clip(frames, palettes), run, "h int, w int, rgb binary, a binary", ("palette",))


def encoded(frames: DataFrame, palettes: DataFrame, fps: float = 25, visible: int = VISIBLE) -> DataFrame:
    """(clip_id, frame_idx, h, w, palette, block): every frame's part of its clip's file."""
    delay = max(1, round(100 / fps))

    def run(rgb: np.ndarray, a: np.ndarray | None, palette: bytes) -> dict:
        return {"h": rgb.shape[0], "w": rgb.shape[1], "palette": palette, "block": G.frame(_index(rgb, a, palette, visible), delay)}

    kept = P.with_clip(frames, palettes)
    return P.map_packed(kept, run, "h int, w int, palette binary, block binary", ("palette",))


def write_gifs(frames: DataFrame, path: str, fps: float = 25, visible: int = VISIBLE) -> None:
    """One looping, transparent GIF per clip below ``path``, by one palette; no file appears when a task fails for good."""
    held = written(frames)
    write_frames(encoded(held, palettes(held, visible), fps, visible), path, "gif")


def write_supersampled_gifs(frames: DataFrame, path: str, fps: float = 25, factor: int = 4, visible: int = VISIBLE) -> None:
    """As ``write_gifs``, of frames brought into colours at ``factor`` times their size and averaged back first."""

    def enlarge(rgb: np.ndarray, a: np.ndarray) -> dict:
        h, w = (factor * n for n in a.shape)
        big = [np.clip(np.rint(lanczos(x, h, w)), 0, 255).astype(np.uint8) for x in (rgb, a)]
        return {"h": h, "w": w, "rgb": big[0], "a": big[1]}

    def reduce(rgb: np.ndarray, a: np.ndarray) -> dict:
        h, w = (n // factor for n in a.shape)
        return {"h": h, "w": w, "rgb": area(rgb, h, w), "a": area(a, h, w)}

    form = "h int, w int, rgb binary, a binary"
    big = written(P.map_packed(frames, enlarge, form))
    write_gifs(P.map_packed(quantised(big, palettes(big, visible), visible), reduce, form), path, fps)


def write_ss_alpha_gifs(frames: DataFrame, path: str, fps: float = 25, factor: int = 4, visible: int = VISIBLE) -> None:
    """As ``write_gifs``, of frames whose alpha is decided at ``factor`` times their size; colours are brought to a palette once."""

    def decide(rgb: np.ndarray, a: np.ndarray) -> dict:
        return {"h": a.shape[0], "w": a.shape[1], "rgb": rgb, "a": supersample_threshold(a, factor, visible).astype(np.uint8)}

    write_gifs(P.map_packed(frames, decide, "h int, w int, rgb binary, a binary"), path, fps)


def read_gifs(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame_idx, h, w, rgb, a) of the .gif files below ``path``, named by their clips; a damaged file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gif").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                clip = batch.column("path")[k].as_py().rsplit("/", 1)[1].removesuffix(".gif")
                for i, (rgb, a) in enumerate(G.decoded(batch.column("content")[k].as_py())):
                    values = (clip, i, *a.shape, rgb.tobytes(), a.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[f.split()[0] for f in FRAMES.split(", ")])

    return files.mapInArrow(run, FRAMES)
