"""Extension: segmentation of live frame streams.

The batch score is scaled by each video's minimum and maximum, which a stream does not know; here the
bounds are given. State per video is the open segment only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "video_key string, start_index int, end_index int, start_time_sec double, end_time_sec double, peak_score double, mean_score double"
_STATE = "start int, start_time double, peak double, total double, n long, last int, last_time double"


def scaled(frames: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Adds score: the column scaled by known bounds, held to [0, 1]."""
    if high <= low:
        raise ValueError("high must exceed low")
    return frames.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low) / (high - low))))


def segment_stream(frames: DataFrame, threshold: float, min_seconds: float, max_seconds: float | None = None, idle_ms: int | None = None) -> DataFrame:
    """Closed segments of a stream with video_key, frame_ordinal, time_sec and score, in append mode.

    Frames of a video must arrive in order across micro-batches; inside one they are sorted, three numbers a
    frame. A video without new frames for ``idle_ms`` is closed: its tail becomes a last segment and its state
    goes; without ``idle_ms`` the tail stays open and the state stays.
    """
    longest = float("inf") if max_seconds is None else max_seconds
    names = [x.split()[0] for x in _OUT.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = []
        if state.hasTimedOut:
            if now and now[5] > now[0]:
                rows.append((key[0], now[0], now[5], now[1], now[6], now[2], now[3] / now[4]))
            state.remove()
            yield pd.DataFrame(rows, columns=names)
            return
        pdf = pd.concat([b[["frame_ordinal", "time_sec", "score"]] for b in batches]).sort_values("frame_ordinal")
        for i, t, s in zip(pdf["frame_ordinal"], pdf["time_sec"], pdf["score"], strict=True):
            i, t, s = int(i), float(t), float(s)
            if now is not None:
                now[2], now[3], now[4], now[5], now[6] = max(now[2], s), now[3] + s, now[4] + 1, i, t
                age = t - now[1]
                if not ((s >= threshold and age >= min_seconds) or age >= longest):
                    continue
                rows.append((key[0], now[0], i, now[1], t, now[2], now[3] / now[4]))
            now = [i, t, s, s, 1, i, t]
        state.update(tuple(now))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=names)

    keyed = frames.select("video_key", "frame_ordinal", F.col("time_sec").cast("double"), F.col("score").cast("double"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return keyed.groupBy("video_key").applyInPandasWithState(update, _OUT, _STATE, "append", timeout)
