"""Extension: segmentation of streams whose frames arrive late and out of order, in event time.

State of a video: its open segment, typed, its timer, and the frames that wait, in one value: every call to the state store is a
message to the JVM, and a video in a micro-batch takes one to read and one to write, and two where its timer moves. A frame waits until the watermark has passed
it, since then none before it can come; those frames go through the scan in order. A timer wakes a video at its next
waiting frame, and one after its last frame and ``idle_seconds`` closes it, so its tail becomes a segment and its state goes; a
frame after a longer gap begins the video anew, whatever micro-batch it comes in.
A stream can go on where a batch index ends: the index gives the open segments as initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from chronoreel.operators.segments import _Scan

OUT = "video_key string, segment_no int, start_index int, end_index int, start_time_sec double, end_time_sec double, duration_sec double, peak_score double, mean_score double"
NAMES = [x.split()[0] for x in OUT.split(", ")]
#: Also the columns of an initial state, after video_key; origin is the first frame's time in microseconds.
OPEN = "segment_no int, start_index int, start_time float, peak float, total double, n bigint, last_index int, last_time float, origin bigint, last_at bigint"
#: The state of a video; where no frame was released yet, the columns of OPEN are null.
STATE = f"{OPEN}, timer bigint, waiting binary"
FRAME = np.dtype([("at", "<i8"), ("tie", "<i8"), ("score", "<f4")])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedSegments(StatefulProcessor):
    def __init__(self, threshold: float, min_seconds: float, max_seconds: float | None, idle_seconds: float) -> None:
        self.settings, self.idle = (threshold, min_seconds, max_seconds), round(idle_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("video", STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for row in initialState.drop(columns=["video_key"]).itertuples(index=False):
            timer = -(-(int(row.last_at) + self.idle) // 1000)
            self.state.update((*(x.item() if hasattr(x, "item") else x for x in row), timer, b""))
            self.handle.registerTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            if pdf["at"].dtype.kind != "i" or pdf["tie"].dtype.kind != "i":
                raise ValueError("frames have a time and a tie")
            new.append(np.empty(len(pdf), FRAME))
            for c in FRAME.names:
                new[-1][c] = pdf[c].to_numpy()
        yield from self._released(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._released(key, timerValues.getCurrentWatermarkInMs(), [])

    def _released(self, key: tuple, watermark: int, new: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """Segments closed by the frames that the watermark has passed; sets the next timer."""
        before = self.state.get()
        *state, timer, held = before if before is not None else (*[None] * 10, None, b"")
        waiting = np.concatenate([np.frombuffer(bytes(held), FRAME), *new])
        waiting = waiting[np.lexsort((waiting["score"], waiting["tie"], waiting["at"]))]
        n_ready = int(np.searchsorted(waiting["at"], watermark * 1000, side="right"))
        ready, rest = waiting[:n_ready], waiting[n_ready:]
        state = state if state[0] is not None else None
        scan, origin, last_at = _Scan(*self.settings), None, None
        if state is not None:
            number, start, start_time, peak, total, n, last, last_time, origin, last_at = state
            scan.key, scan.number, scan.start, scan.start_time = key[0], number, start, np.float32(start_time)
            scan.peak, scan.total, scan.n, scan.last, scan.last_time = np.float32(peak), total, n, last, np.float32(last_time)
        times = ready["at"]
        for part in np.split(np.arange(len(ready)), np.flatnonzero(np.diff(times) > self.idle) + 1) if len(ready) else []:
            if last_at is None or times[part[0]] - last_at > self.idle:
                scan.finish()
                origin, first = int(times[part[0]]), 0
            else:
                first = scan.last + 1
            seconds = ((times[part] - origin) / 1e6).astype(np.float32)
            scan.feed(key[0], np.arange(first, first + len(part)), seconds, ready["score"][part])
            last_at = int(times[part[-1]])
        now: tuple | None = None
        if last_at is not None and last_at + self.idle <= watermark * 1000:
            scan.finish()
        elif last_at is not None:
            now = (scan.number, scan.start, float(scan.start_time), float(scan.peak), float(scan.total), int(scan.n), scan.last, float(scan.last_time), int(origin), int(last_at))
        until = None
        if len(rest) or now is not None:
            until = max(watermark + 1, -(-(int(rest["at"][0]) if len(rest) else last_at + self.idle) // 1000))
            self.state.update((*(now or [None] * 10), until, rest.tobytes()))
        elif before is not None:
            self.state.clear()
        if until != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if until is not None:
                self.handle.registerTimer(until)
        if scan.rows:
            yield pd.DataFrame(scan.rows, columns=NAMES)


def segment_events(
    frames: DataFrame, threshold: float, min_seconds: float, max_seconds: float | None = None, delay: str = "1 hour", idle_seconds: float = 3600.0, initial: DataFrame | None = None
) -> DataFrame:
    """Closed segments of a stream of (video_key, ts, tie, score), in append mode.

    Frames are ordered by ts and then tie, and numbered so. What comes later than ``delay`` behind the latest is
    dropped. ``initial``: video_key and OPEN, see ``open_segments``. Needs the RocksDB state store, which is set here.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = frames.select("video_key", "ts", F.col("tie").cast("long").alias("tie"), F.col("score").cast("float").alias("score"))
    rows = rows.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    start = None if initial is None else initial.groupBy("video_key")
    return rows.groupBy("video_key").transformWithStateInPandas(OrderedSegments(threshold, min_seconds, max_seconds, idle_seconds), OUT, "append", "eventTime", start)


def open_segments(frames: DataFrame, threshold: float, min_seconds: float, max_seconds: float | None = None) -> DataFrame:
    """The open segment of each video of a batch (video_key, ts, tie, score), as the initial state of a stream that goes on from there."""
    rows = frames.select("video_key", F.unix_micros("ts").alias("at"), F.col("tie").cast("long").alias("tie"), F.col("score").cast("float").alias("score"))
    settings = (threshold, min_seconds, max_seconds)
    names = ["video_key", *[x.split()[0] for x in OPEN.split(", ")]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, origin, last_at = _Scan(*settings), None, None

        def state() -> pd.DataFrame:
            row = (one.key, one.number, one.start, one.start_time, one.peak, one.total, one.n, one.last, one.last_time, origin, last_at)
            return pd.DataFrame([row], columns=names)

        for pdf in batches:
            for key, group in pdf.groupby("video_key", sort=False):
                if key != one.key:
                    if one.key is not None:
                        yield state()
                    one, origin, n = _Scan(*settings), int(group["at"].iloc[0]), 0
                else:
                    n = one.last + 1
                times = ((group["at"] - origin) / 1e6).to_numpy().astype(np.float32)
                one.feed(key, np.arange(n, n + len(group)), times, group["score"].to_numpy(np.float32))
                one.rows, last_at = [], int(group["at"].iloc[-1])
        if one.key is not None:
            yield state()

    return rows.repartition("video_key").sortWithinPartitions("video_key", "at", "tie").mapInPandas(scan, f"video_key string, {OPEN}")
