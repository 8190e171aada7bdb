"""Change against the frame before, where frames stay in the tasks that have them.

A task goes through its frames in order and compares neighbours; of each run of a video only the first and the last frame's
values leave it, as the first has its neighbour in another task. Those edges, two for each task and video, are shuffled and
compared. So images and vectors are not shuffled, and a long video is the work of many tasks. Where tasks hold frames of a
video that lie between each other's, the frames are dealt into ranges of (video, ordinal) first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.operators.signals import energy_between, luminance
from chronoreel.plans.store import written_once


@dataclass(frozen=True)
class Change:
    """How a column's value becomes an array, and what two neighbours' arrays give."""

    prepare: Callable[[object], np.ndarray]
    between: Callable[[np.ndarray, np.ndarray], float]
    dtype: str


#: Mean absolute change of luminance over 255, from image structs.
ENERGY = Change(lambda image: luminance(image["data"], image["height"], image["width"], image["nChannels"]).ravel(), lambda now, before: energy_between(now, before), "int16")
#: 1 - clamped dot product, from vectors of length one.
DRIFT = Change(lambda v: np.asarray(v, np.float64), lambda now, before: 1.0 - min(1.0, max(-1.0, float((now * before).sum()))), "float64")


def runs(frames: DataFrame, column: str, change: Change) -> DataFrame:
    """(video_key, frame_ordinal, part, value, edge, first): value is null for the first frame of a run, edge is there for its first and last."""
    names = ["video_key", "frame_ordinal", "part", "value", "edge", "first"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, before = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            out = []
            for key, ordinal, value in zip(pdf["video_key"], pdf["frame_ordinal"], pdf[column], strict=True):
                now = change.prepare(value)
                first = last is None or last[0] != key
                if last is not None:
                    # Only now is it known whether the row before is the last of its run.
                    out.append((*last[:4], before.tobytes() if first or last[5] else None, last[5]))
                last, before = (key, ordinal, part, None if first else change.between(now, before), None, first), now
            yield pd.DataFrame(out, columns=names).astype({"value": "float64"})
        if last is not None:
            yield pd.DataFrame([(*last[:4], before.tobytes(), last[5])], columns=names).astype({"value": "float64"})

    rows = frames.select("video_key", "frame_ordinal", column).sortWithinPartitions("video_key", "frame_ordinal")
    kind = frames.schema["frame_ordinal"].dataType.simpleString()
    return rows.mapInPandas(scan, f"video_key string, frame_ordinal {kind}, part int, value double, edge binary, first boolean")


def in_order(found: DataFrame) -> bool:
    """Whether no task has frames of a video between another's."""
    ends = found.where(F.col("edge").isNotNull()).groupBy("video_key", "part").agg(F.min("frame_ordinal").alias("a"), F.max("frame_ordinal").alias("b"))
    before = F.max("b").over(Window.partitionBy("video_key").orderBy("a", "part").rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("before", before).where(F.col("before") >= F.col("a")).isEmpty()


def change_between(frames: DataFrame, column: str, change: Change, out: str) -> DataFrame:
    """(video_key, frame_ordinal, ``out``): the change against the frame before, 0 for a video's first frame.

    Null values are not allowed. Frames with one ordinal are neighbours in any order.
    """
    found = written_once(runs(frames, column, change))
    if not in_order(found):
        found = written_once(runs(frames.repartitionByRange("video_key", "frame_ordinal"), column, change))

    @F.pandas_udf("double")
    def compare(now: pd.Series, before: pd.Series) -> pd.Series:
        read = lambda b: np.frombuffer(b, change.dtype)
        return pd.Series([0.0 if b is None else change.between(read(a), read(b)) for a, b in zip(now, before, strict=True)], dtype="float64")

    edges = found.where(F.col("edge").isNotNull()).withColumn("before", F.lag("edge").over(Window.partitionBy("video_key").orderBy("frame_ordinal", "part", F.col("first").desc())))
    firsts = edges.where("first").select("video_key", "frame_ordinal", compare("edge", "before").alias(out))
    return found.where(~F.col("first")).select("video_key", "frame_ordinal", F.col("value").alias(out)).unionAll(firsts)


def frame_energy(frames: DataFrame) -> DataFrame:
    """(video_key, frame_ordinal, energy) of frames with an image."""
    return change_between(frames, "image", ENERGY, "energy").withColumn("energy", F.col("energy").cast("float"))


def cosine_drift(frames: DataFrame, column: str = "embedding", out: str = "drift") -> DataFrame:
    """(video_key, frame_ordinal, ``out``) of frames with a vector; the window form in ``signals`` is for videos that fit a task."""
    return change_between(frames, column, DRIFT, out)
