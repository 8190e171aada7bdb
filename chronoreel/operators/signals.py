"""Change signals per frame. All windows share one partitioning by video, so the chain shuffles once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.config import IndexConfig
from chronoreel.functions.vectors import clamp, dot


def _video() -> Window:
    return Window.partitionBy("video_key")


def stride(frames: DataFrame, fps: float) -> DataFrame:
    """Every step-th native frame, step = max(round(native_fps / fps), 1) with halves to even; adds time_sec.

    Input: video_key, native_index, native_fps. A plain filter and projection.
    """
    step = F.greatest(F.rint(F.col("native_fps") / fps).cast("int"), F.lit(1))
    kept = frames.where(F.col("native_index") % step == 0)
    return kept.withColumn("frame_ordinal", F.expr("cast(native_index div greatest(cast(rint(native_fps / %r) as int), 1) as int)" % float(fps))).withColumn(
        "time_sec", (F.col("native_index") / F.col("native_fps")).cast("float")
    )


def cosine_drift(frames: DataFrame, column: str = "embedding", out: str = "drift") -> DataFrame:
    """1 - clamped dot product with the frame before; 0 for the first. Vectors are taken to have length one."""
    last = F.lag(column).over(_video().orderBy("frame_ordinal"))
    return frames.withColumn(out, F.coalesce(1 - clamp(dot(F.col(column), last)), F.lit(0.0)))


def minmax(column: str) -> Column:
    """The column scaled to [0, 1] over its video; all zero where it is constant."""
    x = F.col(column).cast("double")
    low, high = F.min(x).over(_video()), F.max(x).over(_video())
    flat = F.abs(high - low) <= F.lit(1e-9) * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, F.lit(0.0)).otherwise((x - low) / (high - low))


def fuse(signals: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Adds combined: the weighted mean of the scaled energy, openclip and dino signals, as float."""
    weights = {"openclip": config.openclip_weight, "dino": config.dino_weight, "energy": config.energy_weight}
    scaled = signals.select("*", *[minmax(c).alias(f"__{c}") for c in weights])
    total = sum((F.col(f"__{c}") * w for c, w in weights.items()), F.lit(0.0))
    return scaled.withColumn("combined", (total / sum(weights.values())).cast("float")).drop(*[f"__{c}" for c in weights])


def gray(pixels: np.ndarray) -> np.ndarray:
    """Blue-green-red bytes (..., 3) as rounded 8-bit luminance."""
    return np.rint(pixels.astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def luminance(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The luminance of an image's bytes; images of one channel are their own."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (pixels[..., 0] if channels == 1 else gray(pixels[..., :3])).astype(np.int16)


def energy_between(now: np.ndarray, before: np.ndarray | None) -> float:
    """Mean absolute change of luminance over 255; 0 without a frame before."""
    return 0.0 if before is None else float(np.abs(now - before).mean() / 255)


def frame_energy(frames: DataFrame) -> DataFrame:
    """Adds energy: mean absolute change of luminance against the frame before, over 255; 0 for the first.

    Input has an ``image`` struct (height, width, nChannels, data). Frames stream through in order with all
    their columns, one image before is kept, whatever a video's length; they are shuffled once, and nothing is
    joined. Where frames come from a decoder, ``sample_videos(energy=True)`` adds the column without a shuffle.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, before = object(), None
        for pdf in batches:
            out = []
            for key, image in zip(pdf["video_key"], pdf["image"], strict=True):
                now = luminance(image["data"], image["height"], image["width"], image["nChannels"])
                out.append(energy_between(now, before if key == video else None))
                video, before = key, now
            yield pdf.assign(energy=np.array(out, np.float32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.repartition("video_key").sortWithinPartitions("video_key", "frame_ordinal").mapInPandas(scan, f"{schema}, energy float")
