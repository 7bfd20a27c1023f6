"""Frames in files, as a data source of its own: raw video read by ranges of frames, raw video and GIFs written whole or not at all.

Raw files hold the pixels of all frames one after the other and their size in the name, as
clip-640x480.rgb or .rgba.  Files are opened by pyarrow's file systems, where the tasks are.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from framegrid.functions import gif as G
from framegrid.functions.resample import area

_NAME = re.compile(r"([^/]+)-(\d+)x(\d+)\.(rgba?)$")
FRAMES = "clip_id string, frame_idx int, h int, w int, rgb binary, a binary"
#: Bytes of frames that a partition reads, and partitions from which on smaller ranges share one, up to RANGE bytes.
RANGE, MANY = 64 << 20, 500
#: Frames, and bytes of them, that go out at once.
BATCH, BATCH_BYTES = 256, 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path if re.match(r"\w[\w+.-]*:", path) else f"file://{os.path.abspath(path)}")


@dataclass
class Range(InputPartition):
    """Frames ``first`` to ``last`` of a file, or those of them in ``only``."""

    path: str
    clip: str
    h: int
    w: int
    channels: int
    first: int
    last: int
    only: frozenset[int] | None = None


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Range]


def shared(ranges: list[Range]) -> list[InputPartition]:
    """``ranges`` as they are, or, if there are more than MANY, neighbours together: at most MANY partitions, or as many as have RANGE bytes."""
    if len(ranges) <= MANY:
        return list(ranges)
    size = lambda r: r.h * r.w * r.channels * (len(r.only) if r.only is not None else r.last - r.first + 1)
    room = min(RANGE, -(-sum(map(size, ranges)) // MANY))
    out: list[Ranges] = []
    held = 0
    for r in ranges:
        if not out or held + size(r) / 2 > room:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += size(r)
    return list(out)


class FrameReader(DataSourceReader):
    """Reads the clips and frames that the options choose.

    They are options and no pushed filters, since Spark 4.1 keeps the filters pushed by one query
    for later ones over the same DataFrame that push none.
    """

    def __init__(self, options: dict):
        self.path, self.scale, self.bytes = options["path"], float(options.get("scale", 1)), int(options.get("bytes", RANGE))
        self.clips = set(json.loads(options["clips"])) if "clips" in options else None
        self.only = set(json.loads(options["only"])) if "only" in options else None
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 2**31 - 1))

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        found = fs.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out = []
        for f in files:
            if f.type != pafs.FileType.File or not re.search(r"\.rgba?$", f.path) or re.search(r"(^|/)[_.]", f.path[len(root) :]):
                continue
            name = _NAME.search(f.path)
            if not name:
                raise ValueError(f"no size in the name of {f.path}")
            clip, w, h, channels = name.group(1), int(name.group(2)), int(name.group(3)), len(name.group(4))
            one = w * h * channels
            if self.clips is not None and clip not in self.clips:
                continue
            if not f.size or not one:
                raise ValueError(f"{clip}: no frames in {f.path}")
            if f.size % one:
                raise ValueError(f"{clip}: {f.size} bytes are no whole frames of {w} x {h}")
            low, high = max(self.low, 0), min(self.high, f.size // one - 1)
            step = max(1, self.bytes // one)
            for at in range(low - low % step, high + 1, step):
                first, last = max(at, low), min(at + step - 1, high)
                only = frozenset(i for i in self.only if first <= i <= last) if self.only is not None else None
                if only is None or only:
                    out.append(Range(f.path, clip, h, w, channels, first, last, only))
        return shared(out) or [Range("", "", 0, 0, 0, 0, -1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for p in partition.ranges if isinstance(partition, Ranges) else [partition]:
            for row in self._frames(p):
                rows.append(row)
                held += 4 * row[2] * row[3]
                if len(rows) == BATCH or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in FRAMES.split(", ")])

    def _frames(self, p: Range) -> Iterator[tuple]:
        if p.last < p.first:
            return
        one = p.h * p.w * p.channels
        fs, _ = opened(self.path)
        with fs.open_input_file(p.path) as file:
            for i in sorted(p.only) if p.only is not None else range(p.first, p.last + 1):
                file.seek(i * one)
                data = file.read(one)
                if len(data) != one:
                    raise ValueError(f"{p.clip}: the file ends within frame {i}")
                x = np.frombuffer(data, np.uint8).reshape(p.h, p.w, p.channels)
                if self.scale != 1:
                    x = area(x, *(max(1, round(n * self.scale)) for n in (p.h, p.w)))
                alpha = np.ascontiguousarray(x[..., 3]).tobytes() if p.channels == 4 else None
                yield p.clip, i, x.shape[0], x.shape[1], np.ascontiguousarray(x[..., :3]).tobytes(), alpha


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final names of the files that a task has finished."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FrameWriter(DataSourceArrowWriter):
    """Each task writes its clips under names of its own; they get their final ones when all tasks are done, and a manifest comes last."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "rgba")
        if self.kind not in ("rgb", "rgba", "gif"):
            raise ValueError(f"unknown kind of file: {self.kind!r}")
        self.job = uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def _name(self, clip: str, row: dict) -> str:
        if "/" in clip or not clip:
            raise ValueError(f"{clip!r} can't be the name of a file")
        return f"{clip}.gif" if self.kind == "gif" else f"{clip}-{row['w']}x{row['h']}.{self.kind}"

    def _bytes(self, row: dict) -> bytes:
        if self.kind == "gif":
            return row["block"]
        if self.kind == "rgb":
            return row["rgb"]
        n = row["h"] * row["w"]
        alpha = np.frombuffer(row["a"], np.uint8) if row["a"] is not None else np.full(n, 255, np.uint8)
        return np.concatenate((np.frombuffer(row["rgb"], np.uint8).reshape(n, 3), alpha[:, None]), axis=1).tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        folder = f"{self._temporary(root)}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        done, file, clip, first, due = Written(), None, None, None, 0

        def close() -> None:
            if file is not None:
                if self.kind == "gif":
                    file.write(G.TAIL)
                file.close()

        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    if str(row["clip_id"]) != clip:
                        close()
                        clip, first, due = str(row["clip_id"]), row, 0
                        name = self._name(clip, row)
                        if any(final.endswith(f"/{name}") for _, final in done.files):
                            raise ValueError(f"{clip}: the frames of a clip must come together")
                        file = fs.open_output_stream(f"{folder}/{name}")
                        done.files.append((f"{folder}/{name}", f"{root}/{name}"))
                        if self.kind == "gif":
                            file.write(G.head(row["w"], row["h"], np.frombuffer(row["palette"], np.uint8).reshape(-1, 3)))
                    if row["frame_idx"] != due:
                        raise ValueError(f"{clip}: frame {row['frame_idx']} where {due} is due")
                    if (row["h"], row["w"]) != (first["h"], first["w"]):
                        raise ValueError(f"{clip}: a frame of {row['w']} x {row['h']} in a clip of {first['w']} x {first['h']}")
                    file.write(self._bytes(row))
                    due += 1
            close()
        except BaseException:
            if file is not None and not file.closed:
                file.close()
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        for temporary, final in files:
            fs.move(temporary, final)
        with fs.open_output_stream(f"{root}/_manifest-{self.job}") as out:
            out.write("".join(f"{final.rsplit('/', 1)[1]}\n" for _, final in sorted(files)).encode())
        self._drop(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*opened(self.path))

    def _drop(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._temporary(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self._temporary(root))


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options)


def read_frames(spark: SparkSession, path: str, scale: float = 1, bytes: int = RANGE, clips: Iterable[str] | None = None, first: int = 0, last: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
    """(clip_id, frame_idx, h, w, rgb, a) of the .rgb and .rgba files below ``path``, made smaller by ``scale`` below 1.

    A partition reads about ``bytes`` of one file, so a long file is many tasks, frame by frame;
    where that makes more than MANY partitions, ranges of fewer than RANGE bytes share one.
    Of files and places only those of ``clips`` and of the frames from ``first`` to ``last``, or
    those in ``only``, are read.  An empty file and a part of a frame are errors; alpha is null in
    .rgb files.
    """
    spark.dataSource.register(FrameFiles)
    chosen = {"scale": scale, "bytes": bytes, "first": first, "last": last, "clips": json.dumps(list(clips)) if clips is not None else None, "only": json.dumps(list(only)) if only is not None else None}
    return spark.read.format("frame_files").options(**{k: str(v) for k, v in chosen.items() if v is not None}).load(path)


def write_frames(frames: DataFrame, path: str, kind: str = "rgba") -> None:
    """One raw file per clip below ``path``; clips are dealt to tasks and written frame by frame.

    Frames of a clip must be numbered from 0 without gaps and be of one size.  When a task fails
    for good no file appears.
    """
    frames.sparkSession.dataSource.register(FrameFiles)
    kept = ["clip_id", "frame_idx", "h", "w", "rgb", "a"] if kind != "gif" else ["clip_id", "frame_idx", "h", "w", "palette", "block"]
    dealt = frames.select(*kept).repartition("clip_id").sortWithinPartitions("clip_id", "frame_idx")
    dealt.write.format("frame_files").option("kind", kind).mode("append").save(path)
