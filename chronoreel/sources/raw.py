"""Uncompressed videos as a data source: frames are cut from their file where they are wanted, and only those.

``spark.read.format("chronoreel_raw").option("fps", 4).load(root)``: a row for each sampled frame. A file is the line
"fps height width channels" and its frames' bytes; its path below the root, without the suffix, is its video_key. Files are planned by byte ranges without being opened, so one
large file is read by many tasks and many small ones by one; a range has the frames that begin in it. The stride and filters on video_key,
native_index, frame_ordinal and time_sec are applied before a frame's bytes are read; a file whose name a filter excludes is
not opened. Option ``images`` (true) says whether there is an image column, ``range_bytes`` how large a range is.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoreel.schemas import FRAMES
from chronoreel.sources.files import _is_dir, list_ranges, store_of

NAME = "chronoreel_raw"
RANGE_BYTES = 64 << 20
FILES = 1024  # of a task at most, however small they are
BATCH = 64
IMAGE = "image struct<height: int, width: int, nChannels: int, data: binary>"

_COMPARE = {D.EqualTo: operator.eq, D.EqualNullSafe: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
_COLUMNS = ("video_key", "native_index", "frame_ordinal", "time_sec")


@dataclass
class FrameRange:
    """The frames of a file that begin in [start, end) of its bytes."""

    path: str
    video_key: str
    start: int
    end: int
    size: int


def _key(path: str) -> str:
    """A file's path below the root without its suffix."""
    folder, _, name = path.lstrip("/").rpartition("/")
    name = name.rpartition(".")[0] or name
    return f"{folder}/{name}" if folder else name


@dataclass
class Ranges(D.InputPartition):
    """What one task reads: a range of a large file, or many small files."""

    ranges: list[FrameRange]


class RawReader(D.DataSourceReader):
    def __init__(self, root: str, fps: float, images: bool, range_bytes: int) -> None:
        self.root, self.fps, self.images, self.range_bytes = root, fps, images, max(1, range_bytes)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _COLUMNS and type(f) in _COMPARE and f.value is not None:
                self.tests.append((column, type(f).__name__, f.value))
            elif column in _COLUMNS and isinstance(f, D.In):
                self.tests.append((column, "In", tuple(v for v in f.value if v is not None)))
            elif not (column in _COLUMNS and isinstance(f, D.IsNotNull)):
                yield f

    def _passes(self, **known) -> bool:
        by_name = {k.__name__: v for k, v in _COMPARE.items()}
        return all(known[c] in v if kind == "In" else by_name[kind](known[c], v) for c, kind, v in self.tests if c in known)

    def partitions(self) -> list[Ranges]:
        import pyarrow.fs

        fs, base = store_of(self.root)
        top = fs.get_file_info(base)
        if top.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if _is_dir(top) else [top]
        out = []
        for x in sorted(found, key=lambda x: x.path):
            hidden = any(part[:1] in ("_", ".") for part in x.path[len(base) :].split("/"))
            key = _key(x.path[len(base) :] if _is_dir(top) else x.base_name)
            if _is_dir(x) or hidden or not self._passes(video_key=key):
                continue
            name = self.root if not _is_dir(top) else f"{self.root.rstrip('/')}{x.path[len(base.rstrip('/')) :]}"
            out += [FrameRange(name, key, at, min(at + self.range_bytes, x.size), x.size) for at in range(0, max(x.size, 1), self.range_bytes)]
        packed, room = [], 0
        for one in out:
            size = one.end - one.start + self.range_bytes / FILES
            if not packed or size > room:
                packed.append(Ranges([]))
                room = self.range_bytes
            packed[-1].ranges.append(one)
            room -= size
        return packed

    def read(self, part: Ranges) -> Iterator:
        for one in part.ranges:
            yield from self._frames(one)

    def _frames(self, part: FrameRange) -> Iterator:
        fs, path = store_of(part.path)
        with fs.open_input_file(path) as file:
            head = file.read(256).partition(b"\n")
            try:
                rate, (h, w, c) = float(head[0].split()[0]), map(int, head[0].split()[1:])
            except (ValueError, IndexError) as e:
                raise ValueError(f"{part.video_key}: not a raw video") from e
            if rate <= 0 or min(h, w, c) <= 0:
                raise ValueError(f"{part.video_key}: frames per second and sizes must be positive")
            skip, size = len(head[0]) + 1, h * w * c
            n = (part.size - skip) // size
            if n <= 0:
                raise ValueError(f"{part.video_key}: no frames")
            step = max(round(rate / self.fps), 1)
            first, last = (min(n, max(0, -(-(at - skip) // size))) for at in (part.start, part.end))
            last = n if part.end >= part.size else last
            rows: list[tuple] = []
            for i in range(-(-first // step) * step, last, step):
                seconds = float(np.float32(i / rate))
                if self._passes(video_key=part.video_key, native_index=i, frame_ordinal=i // step, time_sec=seconds):
                    rows.append((part.video_key, i // step, i, seconds, rate, self._frame(file, skip + i * size, h, w, c) if self.images else None))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _frame(self, file, at: int, h: int, w: int, c: int) -> dict:
        file.seek(at)
        return {"height": h, "width": w, "nChannels": c, "data": file.read(h * w * c)}

    def _batch(self, rows: list[tuple]):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float32(), pa.float64()]
        names = [x.split()[0] for x in FRAMES.split(", ")]
        if self.images:
            kinds.append(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())]))
            names.append("image")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


class RawVideos(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _images(self) -> bool:
        return str(self.options.get("images", "true")).lower() == "true"

    def schema(self) -> str:
        return f"{FRAMES}, {IMAGE}" if self._images() else FRAMES

    def reader(self, schema: StructType) -> RawReader:
        fps = float(self.options.get("fps", 4.0))
        if fps <= 0:
            raise ValueError("fps must be positive")
        return RawReader(self.options["path"], fps, self._images(), int(self.options.get("range_bytes", RANGE_BYTES)))


def raw_videos(spark: SparkSession, root: str, fps: float = 4.0, images: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of the raw videos below ``root``, registered with filter pushdown switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVideos)
    return spark.read.format(NAME).option("fps", fps).option("images", str(images).lower()).option("range_bytes", range_bytes).load(root)


def raw_clips(spark: SparkSession, root: str, images: bool = True) -> DataFrame:
    """All frames of the clips <root>/<video>/<clip>.raw: video_key, clip, frame_ordinal and the other columns.

    Clips are many and small: tasks list the folders of the videos and read what they are dealt, and the driver plans no file.
    """
    if not _is_dir((store := store_of(root))[0].get_file_info(store[1])):
        raise FileNotFoundError(root)
    # A clip's rate is that of its frames, so an endless rate leaves none out.
    reader = RawReader(root.rstrip("/"), float("inf"), images, RANGE_BYTES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield from reader._frames(FrameRange(f"{reader.root}{x['path']}", _key(x["path"]), x["start"], x["end"], x["size"]))

    rows = list_ranges(spark, root, 1, RANGE_BYTES).mapInArrow(read, f"{FRAMES}, {IMAGE}" if images else FRAMES)
    return rows.withColumn("clip", F.element_at(F.split("video_key", "/"), -1)).withColumn("video_key", F.element_at(F.split("video_key", "/"), -2))
