"""Frames of raw video files, made smaller by whole factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framegrid.sources.frame_files import read_frames


def read_raw(spark: SparkSession, path: str, scale: int = 1) -> DataFrame:
    """``read_frames``, made smaller by averaging ``scale`` pixels."""
    return read_frames(spark, path, 1 / scale)
