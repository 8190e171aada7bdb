"""Settings of indexing, retrieval, answering and sampling; checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexConfig:
    """How a video becomes segments."""

    # Fixed values
    sample_fps: float = 4.0
    low_threshold: float = 0.32
    high_threshold: float = 0.58
    low_min_seconds: float = 2.0
    high_min_seconds: float = 12.0
    max_seconds: float | None = None
    openclip_weight: float = 0.45
    dino_weight: float = 0.35
    energy_weight: float = 0.20
    image_batch: int = 16

    def __post_init__(self) -> None:
        if self.sample_fps <= 0:
            raise ValueError("sample_fps must be positive")
        if self.openclip_weight + self.dino_weight + self.energy_weight == 0:
            raise ValueError("the signal weights sum to zero")
        if self.max_seconds is not None and self.max_seconds <= 0:
            raise ValueError("max_seconds must be positive")


@dataclass(frozen=True)
class RetrievalConfig:
    """How a question becomes evidence frames."""

    # Fixed values
    top_high: int = 2
    top_low: int = 3
    max_evidence_frames: int = 8

    def __post_init__(self) -> None:
        if min(self.top_high, self.top_low, self.max_evidence_frames) < 1:
            raise ValueError("top_high, top_low and max_evidence_frames must be at least 1")


#: The evaluation runs look at more frames than the library default.
EVALUATION = RetrievalConfig(max_evidence_frames=64)


@dataclass(frozen=True)
class AnswerConfig:
    """Which model answers and how much it may say."""

    model_id: str = "stub"
    device: str = "cpu"
    max_new_tokens: int = 32


@dataclass(frozen=True)
class SampleConfig:
    """A development subset."""

    # Fixed values
    sample_size: int = 50
    seed: int = 7
    bucket_fields: tuple[str, ...] = ("duration", "domain")


def batch_size(n: int | None) -> int:
    """Batch sizes that are missing or not positive become 1."""
    return n if n and n > 0 else 1


def parse_quotas(items: list[str]) -> dict[str, int]:
    """``["short=10", ...]`` as a mapping; anything else is a ValueError."""
    out: dict[str, int] = {}
    for item in items:
        name, sep, number = item.partition("=")
        if not sep or not name:
            raise ValueError(f"a quota looks like name=count, not {item!r}")
        out[name] = int(number)
    return out
