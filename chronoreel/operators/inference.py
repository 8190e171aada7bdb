"""Models as plug-ins: encoders and answerers that run inside Python workers.

A factory is called once per task and yields the model; it is unloaded when the task ends. Deterministic
stubs stand in where no model is at hand.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.config import batch_size


class Encoder(Protocol):
    """Turns a list of items (texts, images as structs or bytes, or lists of images) into an (n, width) array."""

    def encode(self, items: list) -> np.ndarray: ...

    def unload(self) -> None: ...


class Answerer(Protocol):
    """Answers a prompt, given the evidence frames."""

    def answer(self, prompt: str, frames: list) -> str: ...

    def unload(self) -> None: ...


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def encode(df: DataFrame, column: str, factory: Callable[[], Encoder], batch: int | None = 16, normalize: bool = True, out: str = "embedding") -> DataFrame:
    """``df`` with a vector for each row of ``column``; rows stream through in batches of the model's size.

    No rows give no rows. Null items have a null vector and do not reach the model.
    """
    size = batch_size(batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        try:
            for pdf in batches:
                model = model or factory()
                vectors: list = [None] * len(pdf)
                items = [(i, v.asDict() if hasattr(v, "asDict") else v) for i, v in enumerate(pdf[column]) if v is not None]
                for at in range(0, len(items), size):
                    part = items[at : at + size]
                    x = np.asarray(model.encode([v for _, v in part]), np.float32)
                    for (i, _), v in zip(part, _unit(x) if normalize else x, strict=True):
                        vectors[i] = v
                yield pdf.assign(**{out: vectors})
        finally:
            if model is not None:
                model.unload()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, `{out}` array<float>")


def encode_clips(frames: DataFrame, factory: Callable[[], Encoder], num_frames: int = 8, normalize: bool = True) -> DataFrame:
    """(video_key, embedding): one vector per clip from exactly ``num_frames`` of its frames (image bytes).

    The picks are joined first, so a group holds num_frames images at most.
    """
    from chronoreel.operators.retrieve import resample_exact

    picks = resample_exact(frames, num_frames).withColumnRenamed("frame_index", "frame_ordinal")
    chosen = picks.join(frames.select("video_key", "frame_ordinal", "image"), ["video_key", "frame_ordinal"])
    clips = chosen.groupBy("video_key").agg(F.array_sort(F.collect_list(F.struct("position", "image"))).alias("clip"))
    return encode(clips.select("video_key", F.col("clip.image").alias("clip")), "clip", factory, 2, normalize).select("video_key", "embedding")


def answer(df: DataFrame, factory: Callable[[], Answerer], prompt: str = "prompt", frames: str = "frames") -> DataFrame:
    """``df`` with raw_text and generation_sec; rows without frames are asked with an empty list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        try:
            for pdf in batches:
                model = model or factory()
                texts, times = [], []
                for p, f in zip(pdf[prompt], pdf[frames], strict=True):
                    began = time.perf_counter()
                    texts.append(model.answer(p, [] if f is None else list(f)))
                    times.append(round(time.perf_counter() - began, 3))
                yield pdf.assign(raw_text=texts, generation_sec=times)
        finally:
            if model is not None:
                model.unload()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, raw_text string, generation_sec double")


def device_of(asked: str | None = None) -> str:
    """The device asked for, else a graphics card where a tensor library finds one, else the processor."""
    if asked:
        return asked
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def configured(factory: Callable, device: str | None = None, env: dict[str, str] | None = None) -> Callable:
    """``factory`` with what a run sets: the device, if it takes one, and environment variables, such as an access token, in the worker that makes the model."""
    takes = device is not None and "device" in inspect.signature(factory).parameters

    def make() -> object:
        os.environ.update(env or {})
        return factory(device=device) if takes else factory()

    return make if takes or env else factory


class StubEncoder:
    """A vector from the digest of each item."""

    def __init__(self, width: int = 16):
        self.width = width

    def encode(self, items: list) -> np.ndarray:
        def one(item: object) -> np.ndarray:
            if isinstance(item, (list, np.ndarray)):
                return np.mean([one(x) for x in item], axis=0)
            item = item["data"] if isinstance(item, dict) else item
            data = item.encode() if isinstance(item, str) else bytes(item)
            digest = hashlib.sha256(data).digest()
            return np.resize(np.frombuffer(digest, np.uint8), self.width).astype(np.float32) / np.float32(127.5) - 1

        return np.stack([one(x) for x in items])

    def unload(self) -> None:
        pass


class StubAnswerer:
    """A letter from the digest of the prompt."""

    def answer(self, prompt: str, frames: list) -> str:
        return f"The answer is ({'ABCD'[hashlib.md5(prompt.encode()).digest()[0] % 4]})."

    def unload(self) -> None:
        pass
