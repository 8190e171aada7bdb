"""Videos and frames as tables."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.operators.signals import energy_between, luminance, stride

#: What a decoder yields for a file's bytes: native index, native frames per second, height, width, channels, bytes.
Decoder = Callable[[bytes], Iterator[tuple[int, float, int, int, int, bytes]]]

_IMAGE = "image struct<height: int, width: int, nChannels: int, data: binary>"


def video_paths(videos: DataFrame, root: str) -> DataFrame:
    """Adds path, <root>/<url>.mp4."""
    return videos.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("url"), F.lit(".mp4")))


def availability(spark: SparkSession, root: str, suffix: str = ".mp4") -> DataFrame:
    """(url, path) of the files that exist below ``root``; only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)" + re.escape(suffix) + "$", 1).alias("url"), "path")


def check_available(videos: DataFrame, files: DataFrame) -> DataFrame:
    """``videos`` with available; downloading is up to the caller."""
    here = files.select("url").distinct().withColumn("__here", F.lit(True))
    return videos.join(here, "url", "left").withColumn("available", F.coalesce("__here", F.lit(False))).drop("__here")


def sample_videos(spark: SparkSession, root: str, decoder: Decoder, fps: float = 4.0, images: bool = True, energy: bool = False) -> DataFrame:
    """Sampled frames of every file: video_key, frame_ordinal, native_index, time_sec, native_fps and the image.

    ``energy`` adds the change against the sampled frame before while frames stream by in order.

    One file at a time is in a worker's memory; frames leave it in small batches. A decoder raises ValueError
    for a file it cannot read; a file without frames is an error too.
    """
    files = spark.read.format("binaryFile").load(root).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("video_key"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["video_key", "native_index", "native_fps", "energy", "image"]
        for pdf in batches:
            for key, content in zip(pdf["video_key"], pdf["content"], strict=True):
                rows, n, before = [], 0, None
                for index, rate, h, w, c, data in decoder(bytes(content)):
                    if rate <= 0:
                        raise ValueError(f"{key}: frames per second must be positive")
                    n += 1
                    if index % max(round(rate / fps), 1) == 0:
                        now = luminance(data, h, w, c) if energy else None
                        change = energy_between(now, before) if energy else None
                        rows.append((key, index, rate, change, {"height": h, "width": w, "nChannels": c, "data": data} if images else None))
                        before = now
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if not n:
                    raise ValueError(f"{key}: no frames")
                yield pd.DataFrame(rows, columns=names)

    out = stride(files.mapInPandas(run, f"video_key string, native_index bigint, native_fps double, energy float, {_IMAGE}"), fps)
    return out.drop(*(["energy"] if not energy else []), *(["image"] if not images else []))


def raw_decoder(content: bytes) -> Iterator[tuple[int, float, int, int, int, bytes]]:
    """Uncompressed test videos: a line "fps height width channels", then the frames' bytes."""
    head, _, body = content.partition(b"\n")
    try:
        rate, (h, w, c) = float(head.split()[0]), map(int, head.split()[1:])
    except (ValueError, IndexError) as e:
        raise ValueError("not a raw video") from e
    size = h * w * c
    for i in range(len(body) // size):
        yield i, rate, h, w, c, body[i * size : (i + 1) * size]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as video_key (their folder), frame_ordinal (by name) and image."""
    from pyspark.sql import Window

    images = spark.read.format("image").load(path).select("image")
    parts = F.split("image.origin", "/")
    keyed = images.withColumn("video_key", F.element_at(parts, -2)).withColumn("__name", F.element_at(parts, -1))
    order = F.row_number().over(Window.partitionBy("video_key").orderBy("__name")) - 1
    return keyed.withColumn("frame_ordinal", order).drop("__name")


def opencv_decoder(content: bytes) -> Iterator[tuple[int, float, int, int, int, bytes]]:
    """Any format that the OpenCV library reads. It reads files only, so the bytes go through one in the task's own folder."""
    import os
    import tempfile

    try:
        import cv2
    except ImportError as e:
        raise RuntimeError("this decoder needs the cv2 library") from e
    with tempfile.NamedTemporaryFile(suffix=".mp4", delete=False) as file:
        file.write(content)
    capture = cv2.VideoCapture(file.name)
    try:
        rate = float(capture.get(cv2.CAP_PROP_FPS) or 0.0)
        if not capture.isOpened() or rate <= 0:
            raise ValueError("not a video that can be read")
        for index in itertools.count():
            there, frame = capture.read()
            if not there:
                return
            h, w, c = frame.shape
            yield index, rate, h, w, c, frame.tobytes()
    finally:
        capture.release()
        os.unlink(file.name)


def fetch_missing(videos: DataFrame, root: str, fetch: Callable[[str, str], None] | None = None) -> DataFrame:
    """``videos`` with path, after ``fetch(url, path)`` was called for each that is missing below ``root``.

    Calls run in the workers, one for each url; without ``fetch`` a missing video is a FileNotFoundError.
    """
    there = check_available(video_paths(videos, root), availability(videos.sparkSession, root))
    lost = there.where(~F.col("available")).select("url", "path").distinct()
    if fetch is None:
        for r in lost.limit(1).collect():
            raise FileNotFoundError(r["path"])
    else:

        def each(rows: Iterator) -> None:
            for row in rows:
                fetch(row["url"], row["path"])

        lost.foreachPartition(each)
    return there.drop("available")
