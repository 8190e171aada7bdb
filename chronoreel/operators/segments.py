"""Greedy segmentation and what is computed per segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel import schemas
from chronoreel.functions.text import segment_id
from chronoreel.functions.vectors import l2_normalize


class _Scan:
    """The scan of one video: open segment, its start, running peak and sum.

    Times and scores are float32; they are compared with the settings in double precision.
    """

    def __init__(self, threshold: float, min_seconds: float, max_seconds: float | None):
        self.threshold, self.shortest = float(threshold), float(min_seconds)
        self.longest = np.inf if max_seconds is None else float(max_seconds)
        self.key: object = None
        self.rows: list[tuple] = []

    def _emit(self, end: int, end_time: np.float32) -> None:
        start, start_time = float(self.start_time), float(end_time)
        self.rows.append((self.key, self.number, self.start, end, start, start_time, max(0.0, start_time - start), float(self.peak), self.total / self.n))
        self.number += 1

    def finish(self) -> None:
        """The tail of the video becomes a last segment unless its last frame already is a boundary."""
        if self.key is not None and self.last > self.start:
            self._emit(self.last, self.last_time)
        self.key = None

    def _open(self, i: int, t: np.float32, s: np.float32) -> None:
        self.start, self.start_time, self.peak, self.total, self.n = i, t, s, float(s), 1

    def feed(self, key: object, ordinal: np.ndarray, time: np.ndarray, score: np.ndarray) -> None:
        """Consecutive frames of one video, in order."""
        at = 0
        if key != self.key:
            self.finish()
            self.key, self.number = key, 0
            self._open(int(ordinal[0]), time[0], score[0])
            self.last, self.last_time = int(ordinal[0]), time[0]
            at = 1
        while at < len(ordinal):
            age = (time[at:] - self.start_time).astype(np.float64)
            hits = ((score[at:].astype(np.float64) >= self.threshold) & (age >= self.shortest)) | (age >= self.longest)
            cut = int(hits.argmax()) if hits.any() else -1
            stop = len(ordinal) if cut < 0 else at + cut + 1
            self.peak = max(self.peak, score[at:stop].max())
            self.total += float(score[at:stop].astype(np.float64).sum())
            self.n += stop - at
            self.last, self.last_time = int(ordinal[stop - 1]), time[stop - 1]
            if cut >= 0:
                self._emit(self.last, self.last_time)
                self._open(self.last, self.last_time, score[stop - 1])
            at = stop


def segment_levels(frames: DataFrame, levels: dict[str, tuple[float, float]], max_seconds: float | None = None, score: str = "combined") -> DataFrame:
    """Segments of each video at each level (threshold, least seconds), in one pass.

    Rows have schema SEGMENT_SCAN and segment_id; neighbours share their boundary frame. A frame ends a
    segment if its score reaches the threshold at least that many seconds after the last boundary, or if
    ``max_seconds`` have passed. One frame alone makes no segment. The scan depends on its own last result,
    which no window function expresses; rows stream through it sorted by video and frame, so memory does
    not grow with a video. Only ordinal, time and score are shuffled.
    """
    rows = frames.select("video_key", "frame_ordinal", F.col("time_sec").cast("float").alias("t"), F.col(score).cast("float").alias("s"))
    names = ["video_key", "segment_no", "start_index", "end_index", "start_time_sec", "end_time_sec", "duration_sec", "peak_score", "mean_score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scans = {level: _Scan(threshold, shortest, max_seconds) for level, (threshold, shortest) in levels.items()}

        def out() -> Iterator[pd.DataFrame]:
            for level, scan in scans.items():
                pdf = pd.DataFrame(scan.rows, columns=names)
                pdf.insert(1, "level", level)
                scan.rows = []
                yield pdf

        for pdf in batches:
            keys = pdf["video_key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            ordinal, t, s = pdf["frame_ordinal"].to_numpy(), pdf["t"].to_numpy(np.float32), pdf["s"].to_numpy(np.float32)
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                for scan in scans.values():
                    scan.feed(keys[a], ordinal[a:b], t[a:b], s[a:b])
            yield from out()
        for scan in scans.values():
            scan.finish()
        yield from out()

    ordered = rows.repartition("video_key").sortWithinPartitions("video_key", "frame_ordinal")
    return ordered.mapInPandas(run, schemas.SEGMENT_SCAN).withColumn("segment_id", segment_id(F.col("level"), F.col("segment_no")))


def segment_by_threshold(
    frames: DataFrame, threshold: float, min_seconds: float, level: str, max_seconds: float | None = None, score: str = "combined"
) -> DataFrame:
    """Segments at one level; see ``segment_levels``."""
    return segment_levels(frames, {level: (threshold, min_seconds)}, max_seconds, score)


def frames_of(segments: DataFrame, *more: str) -> DataFrame:
    """(video_key, level, segment_no, frame_ordinal): every frame of every segment, both ends included; ``more`` columns go along.

    About as many rows as frames; joined by video and ordinal, it stands for the range join and a long
    video does not become one key.
    """
    return segments.select("video_key", "level", "segment_no", *more, F.explode(F.sequence("start_index", "end_index")).alias("frame_ordinal"))


def mean_pool(embeddings: DataFrame, segments: DataFrame, column: str = "embedding") -> DataFrame:
    """``segments`` with embedding: the mean of their frames' vectors, scaled to length one.

    The segments' own columns travel through the aggregation, so the segmentation runs once.
    """
    key = ["video_key", "level", "segment_no"]
    more = [c for c in segments.columns if c not in key]
    members = frames_of(segments.select(*key, "start_index", "end_index", F.struct(*more).alias("__own")), "__own")
    members = members.join(embeddings.select("video_key", "frame_ordinal", array_to_vector(column).alias("v")), ["video_key", "frame_ordinal"])
    pooled = members.groupBy(*key).agg(F.any_value("__own").alias("__own"), Summarizer.mean(F.col("v")).alias("v"))
    return pooled.select(*key, "__own.*", l2_normalize(vector_to_array("v")).cast("array<float>").alias("embedding"))
