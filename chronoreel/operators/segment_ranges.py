"""Segmentation inside long videos: a video's frames are spread over ranges, and all tasks work on one video.

Where a segment begins in a range depends on the last boundary before it. A range therefore says, for every time that
boundary may have, which boundary would be its last: frames that lead to the same one are told apart by no more than the
last hot frame and the last frame of a run of them, so the summary is short. One pass over the summaries, in order of
ranges, gives each range the boundary it is entered with; then all ranges emit their parts of segments at once, and a sum
per segment joins those that cross ranges. Rows are the same as those of ``segments.segment_levels``, which is right for
videos that one task can go through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.text import segment_id
from chronoreel.plans.store import written_once

_FRAME = ["video_key", "part", "frame_ordinal", "t", "s"]
RANGE_FRAMES = 65_536  # frames of a range, about; more frames are more ranges


def _first_old_enough(t: np.ndarray, starts: np.ndarray, least: float) -> np.ndarray:
    """For each start time the first place in ``t`` (ascending, float32) whose age reaches ``least``; len(t) if none.

    Ages are float32 differences compared in double precision, as the scan of a whole video does.
    """
    at = np.searchsorted(t.astype(np.float64), starts.astype(np.float64) + least)
    padded = np.append(t, np.float32(np.inf))

    def old(k: np.ndarray) -> np.ndarray:
        return (padded[k] - starts).astype(np.float64) >= least

    while (back := (at > 0) & old(np.maximum(at - 1, 0))).any():
        at = at - back
    while (on := ~old(at)).any():
        at = at + on
    return at


def _next(t: np.ndarray, hot: np.ndarray, starts: np.ndarray, after: np.ndarray, shortest: float, longest: float) -> np.ndarray:
    """For boundaries at ``starts``, the first frame from ``after`` on that ends a segment; len(t) if none does."""
    hot_at = np.append(np.flatnonzero(hot), len(t))
    k = _first_old_enough(t[hot_at[:-1]], starts, shortest)
    k = np.maximum(k, np.searchsorted(hot_at[:-1], after))
    found = hot_at[k]
    return found if longest == np.inf else np.minimum(found, np.maximum(_first_old_enough(t, starts, longest), after))


def summary(ordinal: np.ndarray, t: np.ndarray, hot: np.ndarray, shortest: float, longest: float) -> list[tuple]:
    """Runs of frames that lead to one last boundary: (last hot time or None, last time or None, that boundary's ordinal and time)."""
    n = len(t)
    after = _next(t, hot, t, np.arange(1, n + 1), shortest, longest)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    out = []
    ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
    begin = 0
    for end in ends:
        those = np.flatnonzero(hot[begin : end + 1])
        if len(those) or longest < np.inf:
            e = last[end]
            out.append((float(t[begin + those[-1]]) if len(those) else None, float(t[end]) if longest < np.inf else None, int(ordinal[e]), float(t[e])))
        begin = end + 1
    return out


def _pieces(key: str, part: int, ordinal: np.ndarray, t: np.ndarray, s: np.ndarray, threshold: float, shortest: float, longest: float, entry: tuple[int, float] | None) -> list[tuple]:
    """Parts of segments in a range: (key, part, local number or -1 if it began before, start, start time, end or None, end time, last, last time, peak, sum, n)."""
    hot = s.astype(np.float64) >= threshold
    bounds, at = [], np.array([0])
    if entry is None:
        bounds.append(0)
        time = t[:1]
        at = np.array([1])
    else:
        time = np.array([entry[1]], np.float32)
    while at[0] < len(t):
        hit = _next(t, hot, time, at, shortest, longest)
        if hit[0] >= len(t):
            break
        bounds.append(int(hit[0]))
        time, at = t[hit], hit + 1
    double, out = s.astype(np.float64), []

    def add(local: int, start: int, start_time: float, a: int, b: int | None) -> None:
        stop = len(t) if b is None else b + 1
        if stop > a:
            end = (None, None) if b is None else (int(ordinal[b]), float(t[b]))
            out.append((key, part, local, start, start_time, *end, int(ordinal[stop - 1]), float(t[stop - 1]), float(s[a:stop].max()), float(double[a:stop].sum()), stop - a))

    if entry is not None:
        add(-1, entry[0], entry[1], 0, bounds[0] if bounds else None)
    for k, a in enumerate(bounds):
        add(k, int(ordinal[a]), float(t[a]), a, bounds[k + 1] if k + 1 < len(bounds) else None)
    return out


def _by_video(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, part, ordinals, times, scores, the first row's further columns) of one (part, video) after the other.

    Of a range three numbers a frame are held, in arrays; its keys go with their batch.
    """
    held, now = [], None
    for batch in batches:
        keys, parts = batch.column(0), batch.column(1).to_numpy()
        if not len(parts):
            continue
        coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero((coded[1:] != coded[:-1]) | (parts[1:] != parts[:-1])) + 1), len(parts)]
        numbers = [batch.column(k).to_numpy(zero_copy_only=False).astype(kind) for k, kind in ((2, np.int64), (3, np.float32), (4, np.float32))]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = keys[int(a)].as_py(), int(parts[a])
            if now is not None and now[:2] != own:
                yield *now[:2], *(np.concatenate(x) for x in zip(*held, strict=True)), now[2]
                held, now = [], None
            now = now or (*own, [c[int(a)].as_py() for c in batch.columns[5:]])
            held.append([x[a:b] for x in numbers])
    if now is not None:
        yield *now[:2], *(np.concatenate(x) for x in zip(*held, strict=True)), now[2]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema in Spark's words."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    names, columns = [x.split() for x in schema.split(", ")], list(zip(*rows, strict=True)) or [()] * len(schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])


def in_ranges(frames: DataFrame, score: str, ranges: int | None = None) -> DataFrame:
    """(video_key, part, frame_ordinal, t, s): three numbers a frame, dealt by (video, ordinal) and stored.

    There are ``ranges`` of them at least, and more where a range would hold more than about RANGE_FRAMES frames.
    """
    rows = written_once(frames.select("video_key", "frame_ordinal", F.col("time_sec").cast("float").alias("t"), F.col(score).cast("float").alias("s")))
    n = max(ranges or int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_FRAMES))
    return written_once(rows.repartitionByRange(n, "video_key", "frame_ordinal").withColumn("part", F.spark_partition_id()).select(*_FRAME))


def segment_levels(frames: DataFrame, levels: dict[str, tuple[float, float]], max_seconds: float | None = None, score: str = "combined", ranges: int | None = None) -> DataFrame:
    """Segments of each video at each level; see ``segments.segment_levels`` for the rule and the columns.

    ``ranges``: how many ranges all frames are dealt into at least; a task has one range of frames in memory,
    about RANGE_FRAMES at most, so a task's memory does not grow with the frames.
    """
    rows = in_ranges(frames, score, ranges)
    dealt = rows.repartition("part").sortWithinPartitions("part", "video_key", "frame_ordinal")
    longest = np.inf if max_seconds is None else float(max_seconds)
    settings = {level: (float(a), float(b)) for level, (a, b) in levels.items()}

    said_schema = "video_key string, level string, part int, run int, hot_time float, any_time float, to_index int, to_time float, first_index int, first_time float"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, ordinal, t, s, _ in _by_video(batches):
            out = []
            for level, (threshold, shortest) in settings.items():
                found = summary(ordinal, t, s.astype(np.float64) >= threshold, shortest, longest)
                # The range's first frame is where a video begins, if no range is before it: what follows from there is its summary too.
                out += [(key, level, part, -1, None, None, *_last_from_first(ordinal, t, s, threshold, shortest, longest), int(ordinal[0]), float(t[0]))]
                out += [(key, level, part, k, *x, int(ordinal[0]), float(t[0])) for k, x in enumerate(found)]
            yield _table(out, said_schema)

    said = dealt.mapInArrow(summarise, said_schema)

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One boundary at a time goes through the summaries of a video; they stream by in order."""
        video, part, state, done = None, None, None, True
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.video_key, r.level) != video:
                    video, part, state = (r.video_key, r.level), None, None
                if r.part != part:
                    part, done = r.part, False
                    out.append((r.video_key, r.level, int(r.part), *(state or (None, None))))
                if done:
                    continue
                if r.run < 0:
                    if state is None:
                        state, done = (int(r.to_index), np.float32(r.to_time)), True
                    continue
                shortest = settings[r.level][1]
                reached = lambda time, least: not np.isnan(time) and np.float64(np.float32(time) - state[1]) >= least  # noqa: B023,E731
                if reached(r.hot_time, shortest) or reached(r.any_time, longest):
                    state, done = (int(r.to_index), np.float32(r.to_time)), True
            yield pd.DataFrame(out, columns=["video_key", "level", "part", "entry_index", "entry_time"]).astype({"entry_index": "Int32", "entry_time": "float32"})

    order = said.repartition("video_key", "level").sortWithinPartitions("video_key", "level", "part", "run")
    entries = written_once(order.mapInPandas(enter, "video_key string, level string, part int, entry_index int, entry_time float"))
    # Two numbers a level go along with a frame; a list of them would be an object for each frame.
    of_level = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
    given = entries.groupBy(F.col("video_key").alias("__v"), F.col("part").alias("__p")).agg(
        *[of_level(level, c).alias(f"{c}_{k}") for k, level in enumerate(settings) for c in ("entry_index", "entry_time")]
    )
    joined = rows.join(given, F.col("video_key").eqNullSafe(F.col("__v")) & (F.col("part") == F.col("__p"))).drop("__v", "__p")
    ready = joined.repartition("part").sortWithinPartitions("part", "video_key", "frame_ordinal")
    schema = "video_key string, part int, local int, start_index int, start_time double, end_index int, end_time double, last_index int, last_time double, peak double, total double, n long, level string"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, ordinal, t, s, more in _by_video(batches):
            for k, (level, (threshold, shortest)) in enumerate(settings.items()):
                entry = None if more[2 * k] is None else (more[2 * k], more[2 * k + 1])
                yield _table([(*x, level) for x in _pieces(key, part, ordinal, t, s, threshold, shortest, longest, entry)], schema)

    parts = written_once(ready.mapInArrow(emit, schema))
    counted = parts.where(F.col("local") >= 0).groupBy("video_key", "level", "part").agg(F.count(F.lit(1)).alias("k"))
    over = Window.partitionBy("video_key", "level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("k").over(over), F.lit(0))).select(F.col("video_key").alias("__v"), F.col("level").alias("__l"), F.col("part").alias("__p"), "before")
    match = F.col("video_key").eqNullSafe(F.col("__v")) & (F.col("level") == F.col("__l")) & (F.col("part") == F.col("__p")) & (F.col("local") >= 0)
    numbered = parts.join(counted, match, "left").withColumn("no", F.col("before") + F.col("local"))
    whole = numbered.groupBy("video_key", "level", "start_index").agg(
        F.max("no").cast("int").alias("segment_no"), F.max("start_time").alias("start_time_sec"), F.max("end_index").alias("end_index"), F.max("end_time").alias("end_time"),
        F.max("last_index").alias("last_index"), F.max("last_time").alias("last_time"), F.max("peak").alias("peak_score"), (F.sum("total") / F.sum("n")).alias("mean_score"),
    )
    # The last segment of a video is open: its tail counts unless its last frame is the boundary itself.
    whole = whole.withColumn("end_time_sec", F.coalesce("end_time", "last_time")).withColumn("end_index", F.coalesce("end_index", "last_index")).where(F.col("end_index") > F.col("start_index"))
    duration = F.greatest(F.lit(0.0), F.col("end_time_sec") - F.col("start_time_sec")).alias("duration_sec")
    out = whole.select("video_key", "level", "segment_no", "start_index", "end_index", "start_time_sec", "end_time_sec", duration, "peak_score", "mean_score")
    return out.withColumn("segment_id", segment_id(F.col("level"), F.col("segment_no")))


def _last_from_first(ordinal: np.ndarray, t: np.ndarray, s: np.ndarray, threshold: float, shortest: float, longest: float) -> tuple[int, float]:
    """The last boundary of a range whose first frame is one."""
    pieces = _pieces("", 0, ordinal, t, s, threshold, shortest, longest, None)
    return pieces[-1][3], pieces[-1][4]
