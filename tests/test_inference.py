"""What a run sets for its models, decoders of other libraries, and fetching."""

import os
import sys
import types

import numpy as np
import pytest

from chronoreel.operators import inference
from chronoreel.sources import frames as source


def test_device(monkeypatch):
    monkeypatch.setitem(sys.modules, "torch", None)
    assert inference.device_of() == "cpu" and inference.device_of("cuda:1") == "cuda:1"
    card = types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: True))
    monkeypatch.setitem(sys.modules, "torch", card)
    assert inference.device_of() == "cuda"


def test_factories_get_device_and_environment_in_the_worker(spark):
    class Placed:
        def __init__(self, device="none"):
            self.device = device

        def answer(self, prompt, frames):
            return f"{self.device} {os.environ.get('CHRONOREEL_TOKEN')}"

        def unload(self):
            pass

    asked = spark.createDataFrame([("p", None)], "prompt string, frames array<int>")
    said = lambda *settings: inference.answer(asked, inference.configured(Placed, *settings)).first()["raw_text"]
    assert said("cuda:1", {"CHRONOREEL_TOKEN": "t"}) == "cuda:1 t"
    assert said().startswith("none") and "CHRONOREEL_TOKEN" not in os.environ
    assert inference.configured(inference.StubAnswerer, "cuda") is inference.StubAnswerer


def test_opencv_decoder(monkeypatch):
    class Capture:
        def __init__(self, path):
            self.left = [np.full((1, 2, 3), i, np.uint8) for i in range(3)] if open(path, "rb").read() == b"video" else []

        def get(self, _):
            return 8.0

        def isOpened(self):  # noqa: N802
            return bool(self.left)

        def read(self):
            return (True, self.left.pop(0)) if self.left else (False, None)

        def release(self):
            pass

    monkeypatch.setitem(sys.modules, "cv2", types.SimpleNamespace(VideoCapture=Capture, CAP_PROP_FPS=5))
    assert [x[:5] for x in source.opencv_decoder(b"video")] == [(i, 8.0, 1, 2, 3) for i in range(3)]
    with pytest.raises(ValueError, match="not a video"):
        list(source.opencv_decoder(b"other"))
    monkeypatch.setitem(sys.modules, "cv2", None)
    with pytest.raises(RuntimeError, match="cv2"):
        next(source.opencv_decoder(b""))


def test_missing_videos_are_fetched(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x")
    videos = spark.createDataFrame([("a",), ("b",)], "url string")
    with pytest.raises(FileNotFoundError, match="b.mp4"):
        source.fetch_missing(videos, str(tmp_path))

    def fetch(url, path):
        with open(path, "wb") as out:
            out.write(url.encode())

    got = source.fetch_missing(videos, str(tmp_path), fetch)
    assert {r["url"] for r in got.collect()} == {"a", "b"} and (tmp_path / "b.mp4").read_bytes() == b"b"
