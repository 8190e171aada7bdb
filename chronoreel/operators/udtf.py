"""Segmentation as a table function for SQL.

    register(spark)
    SELECT * FROM segment_frames(TABLE(SELECT video_key, frame_ordinal, time_sec, score FROM f) PARTITION BY video_key ORDER BY (frame_ordinal), 0.32, 2.0, NULL)

Rows come one by one, so it is for queries in SQL; ``segments`` and ``segment_ranges`` go through frames in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from chronoreel.operators.segments import _Scan

RESULT = "video_key string, segment_no int, start_index int, end_index int, start_time_sec double, end_time_sec double, duration_sec double, peak_score double, mean_score double"
BATCH = 1024


class _Frames:
    """One partition: frames of a video in the order that the query gives, held in small batches."""

    def __init__(self) -> None:
        self.scan: _Scan | None = None
        self.held: list[tuple] = []

    def _feed(self) -> Iterator[tuple]:
        if self.held:
            i, t, s = zip(*self.held, strict=True)
            self.scan.feed(self.key, np.array(i), np.array(t, np.float32), np.array(s, np.float32))
            self.held = []
        rows, self.scan.rows = self.scan.rows, []
        yield from rows

    def eval(self, row, threshold: float, min_seconds: float, max_seconds: float | None) -> Iterator[tuple]:
        if self.scan is None:
            self.scan, self.key = _Scan(threshold, min_seconds, max_seconds), row["video_key"]
        self.held.append((row["frame_ordinal"], row["time_sec"], row["score"]))
        if len(self.held) == BATCH:
            yield from self._feed()

    def terminate(self) -> Iterator[tuple]:
        if self.scan is not None:
            yield from self._feed()
            self.scan.finish()
            yield from self._feed()


def register(spark: SparkSession, name: str = "segment_frames") -> None:
    spark.udtf.register(name, udtf(_Frames, returnType=RESULT))
