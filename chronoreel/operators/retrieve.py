"""Exact retrieval from coarse to fine segments, and the choice of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.vectors import dot, even_picks, uniform_picks

HIT = ("video_key", "question_id", "level", "segment_id", "segment_no", "start_index", "end_index", "start_time_sec", "end_time_sec", "duration_sec")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best scores per video and question: NaN last, ties by segment; adds rank from 1."""
    order = Window.partitionBy("video_key", "question_id").orderBy(F.isnan("score"), F.col("score").desc(), "segment_no")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _keys(segments: DataFrame, questions: DataFrame) -> list[str]:
    """What segments and questions are joined by: the video, and its shard if both have it."""
    return ["video_key", *(["shard"] if "shard" in segments.columns and "shard" in questions.columns else [])]


def _scored(segments: DataFrame, questions: DataFrame) -> DataFrame:
    """Segments of a video against its questions (video_key, question_id, query)."""
    on = _keys(segments, questions)
    return segments.join(questions.select(*on, "question_id", "query"), on).select(*HIT, dot(F.col("embedding"), F.col("query")).alias("score"))


def top_segments(segments: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k segments of each question's video that are nearest by dot product; exact."""
    return _best(_scored(segments, questions), k)


def low_candidates(high_hits: DataFrame, low: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k nearest low segments that lie wholly inside a high hit of the same question.

    A semi-join with an equality on video and question, so each low segment counts once.
    """
    spans = high_hits.select(F.col("video_key").alias("v"), F.col("question_id").alias("q"), F.col("start_index").alias("a"), F.col("end_index").alias("b"))
    on = _keys(low, questions)
    pairs = low.join(questions.select(*on, "question_id", "query"), on)
    inside = (F.col("video_key") == F.col("v")) & (F.col("question_id") == F.col("q")) & (F.col("start_index") >= F.col("a")) & (F.col("end_index") <= F.col("b"))
    found = pairs.join(spans, inside, "left_semi").select(*HIT, dot(F.col("embedding"), F.col("query")).alias("score"))
    return _best(found, k)


def _capped(frames: Column, budget: int) -> Column:
    """An ascending array, thinned evenly to the budget."""
    thin = F.transform(even_picks(F.size(frames), budget), lambda i: F.get(frames, i))
    return F.when(F.size(frames) <= budget, frames).otherwise(thin)


def evidence_frames(low_hits: DataFrame, frames: DataFrame, budget: int, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(video_key, question_id, position, frame_index, time_sec): even picks of each hit, merged, thinned to the budget.

    A group is the hits of one question, top_low at most. ``prepare`` may add the shard to the picks, and have them broadcast, before they meet the frames.
    """
    hits = low_hits.groupBy("video_key", "question_id").agg(F.collect_list(F.struct("start_index", "end_index")).alias("hits"))
    each = F.greatest(F.lit(1), F.expr(f"{int(budget)} div greatest(size(hits), 1)")).cast("int")

    def picks(h: Column) -> Column:
        n = h["end_index"] - h["start_index"] + 1
        return F.transform(uniform_picks(n, each), lambda i: h["start_index"] + i)

    merged = hits.select("video_key", "question_id", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", picks)))).alias("all"))
    placed = merged.select("video_key", "question_id", F.posexplode(_capped(F.col("all"), budget)).alias("position", "frame_index"))
    placed = placed if prepare is None else prepare(placed)
    on = _keys(frames, placed)
    times = frames.select(*on, F.col("frame_ordinal").alias("frame_index"), "time_sec")
    return times.join(placed, [*on, "frame_index"]).select("video_key", "question_id", "position", "frame_index", F.col("time_sec").cast("double").alias("time_sec"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_key").agg(F.count(F.lit(1)).cast("int").alias("n"))


def uniform_frames(frames: DataFrame, budget: int | Column) -> DataFrame:
    """(video_key, position, frame_index): all frames of a video, or ``budget`` even picks."""
    return frame_counts(frames).select("video_key", F.posexplode(uniform_picks(F.col("n"), budget)).alias("position", "frame_index"))


def resample_exact(frames: DataFrame, num_frames: int = 8) -> DataFrame:
    """Exactly ``num_frames`` even picks of each video, with repeats where it is shorter. Videos without frames have no row."""
    if num_frames < 1:
        raise ValueError("num_frames must be at least 1")
    return frame_counts(frames).select("video_key", F.posexplode(even_picks(F.col("n"), num_frames)).alias("position", "frame_index"))


def frame_budget(questions: DataFrame, exported: DataFrame, max_frames: int) -> DataFrame:
    """``questions`` with frame_budget: the frames that retrieval exported (at least 1), or ``max_frames`` if none is known.

    ``exported``: video_key, question_id, n_frames; a row with 0 means a folder without frames.
    """
    known = exported.select("video_key", "question_id", F.greatest(F.lit(1), F.col("n_frames")).cast("int").alias("known"))
    return questions.join(known, ["video_key", "question_id"], "left").withColumn("frame_budget", F.coalesce("known", F.lit(max_frames))).drop("known")
