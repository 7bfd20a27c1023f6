"""Contact sheets: the worst frames of a clip side by side over magenta, as one image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.functions import packed as P
from framegrid.functions.resample import resized

#: The colour behind transparent pixels.
MAGENTA = (255, 0, 255)


def over(rgb: np.ndarray, a: np.ndarray, colour: tuple = MAGENTA) -> np.ndarray:
    share = a[..., None] / 255.0
    return np.floor(np.round(share * rgb + (1 - share) * np.array(colour), 9)).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """An image file of eight bits a channel, of three or four channels."""
    h, w, channels = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def previews(frames: DataFrame, edge: int = 360) -> DataFrame:
    """(clip_id, frame_idx, h, w, rgb, a, png): frames whose longer side is at most ``edge``, larger ones averaged down, as image files with alpha."""

    def run(rgb: np.ndarray, a: np.ndarray | None) -> dict:
        share = min(1.0, edge / max(rgb.shape[:2]))
        h, w = (max(1, int(np.rint(n * share))) for n in rgb.shape[:2])
        a = np.full(rgb.shape[:2], 255, np.uint8) if a is None else a
        small = resized(rgb, h, w), resized(a, h, w)
        return {"h": h, "w": w, "rgb": small[0], "a": small[1], "png": png(np.dstack(small))}

    return P.map_packed(frames, run, "h int, w int, rgb binary, a binary, png binary")


def sheets(frames: DataFrame, picks: DataFrame) -> DataFrame:
    """(clip_id, frames array<int>, h, w, rgb, png): for every clip the picked frames (clip_id, frame_idx) in their order, each once.

    Picks are few a clip, as are its worst frames by some metrics; frames of another height are an error.
    """
    clip = frames.schema["clip_id"].dataType.simpleString()
    chosen = picks.select("clip_id", "frame_idx").where("frame_idx is not null").distinct()
    tiles = frames.join(chosen, ["clip_id", "frame_idx"]).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "h", "w", "rgb", "a"))).alias("tiles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tiles in batch.column("tiles").to_pylist():
                images = [over(np.frombuffer(t["rgb"], np.uint8).reshape(t["h"], t["w"], 3), np.frombuffer(t["a"], np.uint8).reshape(t["h"], t["w"])) for t in tiles]
                sheet = np.concatenate(images, axis=1)
                out.append(([t["frame_idx"] for t in tiles], *sheet.shape[:2], sheet.tobytes(), png(sheet)))
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["clip_id", "frames", "h", "w", "rgb", "png"])

    return tiles.mapInArrow(run, f"clip_id {clip}, frames array<int>, h int, w int, rgb binary, png binary")
