"""Indexing and retrieval as chains of operators, for all videos at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.config import IndexConfig, RetrievalConfig
from chronoreel.functions.text import mcq_prompt
from chronoreel.operators.evaluate import result_rows
from chronoreel.operators.inference import answer
from chronoreel.functions.vectors import uniform_picks
from chronoreel.operators.retrieve import evidence_frames, frame_budget, frame_counts, low_candidates, top_segments
from chronoreel.operators.segments import mean_pool, segment_levels
from chronoreel.operators.halo import frame_energy
from chronoreel.operators.signals import cosine_drift, fuse
from chronoreel.plans.store import written_once


@dataclass(frozen=True)
class VideoIndex:
    """The tables of an index, each keyed by video_key."""

    signals: DataFrame
    high: DataFrame
    low: DataFrame

    def write(self, path: str) -> None:
        for name in ("signals", "high", "low"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> VideoIndex:
        return VideoIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("signals", "high", "low")))


def build_signals(frames: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Frames with embedding, dino_embedding and image or energy become drift, energy and combined score."""
    if "energy" not in frames.columns:
        # Images stay where they are: their energy comes back as a number a frame.
        frames = frames.drop("image").join(frame_energy(frames), ["video_key", "frame_ordinal"])
    drifts = cosine_drift(cosine_drift(frames, "embedding", "openclip"), "dino_embedding", "dino")
    return fuse(drifts.select("video_key", "frame_ordinal", "time_sec", "energy", "openclip", "dino"), config)


def build_index(frames: DataFrame, config: IndexConfig = IndexConfig()) -> VideoIndex:
    """Signals, then segments at two levels with pooled vectors; the index is segmented and pooled once."""
    signals = build_signals(frames, config)
    levels = {"high": (config.high_threshold, config.high_min_seconds), "low": (config.low_threshold, config.low_min_seconds)}
    pooled = written_once(mean_pool(frames, segment_levels(signals, levels, config.max_seconds)))
    return VideoIndex(signals, pooled.where(F.col("level") == "high"), pooled.where(F.col("level") == "low"))


def retrieve(index: VideoIndex, questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> dict[str, DataFrame]:
    """high_hits, low_hits and evidence for questions (video_key, question_id, query)."""
    high = top_segments(index.high, questions, config.top_high)
    low = low_candidates(high, index.low, questions, config.top_low)
    return {"high_hits": high, "low_hits": low, "evidence": evidence_frames(low, index.signals, config.max_evidence_frames)}


def evaluate(questions: DataFrame, found: dict[str, DataFrame], answerer, prefix: str = "") -> DataFrame:
    """Result rows of the retrieval run; questions without evidence are still asked."""
    lists = found["evidence"].groupBy("video_key", "question_id").agg(F.array_sort(F.collect_list("frame_index")).alias("frames"))
    asked = questions.select("video_key", "question_id", mcq_prompt(F.col("question"), F.col("options"), prefix).alias("prompt"))
    asked = asked.join(lists, ["video_key", "question_id"], "left")
    said = answer(asked, answerer).select("video_key", "question_id", "raw_text", "generation_sec")
    nested = {"high_hits": found["high_hits"].drop("segment_no"), "low_hits": found["low_hits"].drop("segment_no"), "evidence_frames": found["evidence"]}
    return result_rows(questions.drop("query"), said, **nested)


def baseline_frames(questions: DataFrame, frames: DataFrame, max_frames: int = 64, exported: DataFrame | None = None) -> DataFrame:
    """(video_key, question_id, frame_budget, position, frame_index): evenly spaced frames for each question.

    ``exported`` (video_key, question_id, n_frames) matches the budget to what retrieval showed; see ``frame_budget``.
    """
    asked = questions.select("video_key", "question_id")
    asked = asked.withColumn("frame_budget", F.lit(max_frames)) if exported is None else frame_budget(asked, exported, max_frames)
    counted = asked.join(frame_counts(frames), "video_key")
    return counted.select("video_key", "question_id", "frame_budget", F.posexplode(uniform_picks(F.col("n"), F.col("frame_budget"))).alias("position", "frame_index"))


def evaluate_baseline(questions: DataFrame, frames: DataFrame, answerer, max_frames: int = 64, prefix: str = "", exported: DataFrame | None = None) -> DataFrame:
    """Result rows of the uniform baseline, with as many frames as retrieval showed if ``exported`` says so."""
    picks = baseline_frames(questions, frames, max_frames, exported)
    lists = picks.groupBy("video_key", "question_id").agg(F.array_sort(F.collect_list("frame_index")).alias("frames"), F.first("frame_budget").alias("frame_budget"))
    asked = questions.select("video_key", "question_id", mcq_prompt(F.col("question"), F.col("options"), prefix).alias("prompt")).join(lists, ["video_key", "question_id"], "left")
    said = answer(asked, answerer).select("video_key", "question_id", "raw_text", "generation_sec", "frame_budget")
    return result_rows(questions, said, frames=picks.drop("frame_budget"))
