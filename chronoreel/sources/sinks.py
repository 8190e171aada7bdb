"""Where results go: JSON, frames, clips, plots."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoreel.functions.text import frame_tag

CLIPS = 64

def write_results(results: DataFrame, path: str) -> None:
    """One JSON row per question, below url=.../question_id=...; an earlier run is overwritten."""
    results.write.mode("overwrite").partitionBy("url", "question_id").json(path)


def write_result_files(results: DataFrame, root: str, mode: str = "append") -> None:
    """One JSON file per question, <root>/<video>/<question>.json, by the sink that commits."""
    from chronoreel.sources.files import write_files

    path = F.concat("video_key", F.lit("/"), "question_id", F.lit(".json"))
    content = F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"})
    write_files(results.repartition("video_key").select(path.alias("path"), content.alias("content")), root, mode)


def read_result_files(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows of ``write_result_files``, read by the tasks that list the folders of the videos."""
    from chronoreel.sources.files import contents, list_files

    found = contents(list_files(spark, root, 1), root)
    return found.select(F.from_json(F.col("content").cast("string"), schema).alias("row")).select("row.*")


def write_manifest_files(videos: DataFrame, root: str, mode: str = "append") -> None:
    """Videos with nested questions as manifest documents, one a video, which ``read_manifest`` reads as one manifest.

    They lie in 256 folders, <root>/shard=<first two digits of the name>; a folder is one task's and one move at the commit.
    """
    from chronoreel.sources.files import write_files

    content = F.to_json(F.struct(F.array(F.struct(*[c for c in videos.columns if c != "row_no"])).alias("videos")))
    name = F.md5(F.concat_ws("|", "video_id", "url").cast("binary"))
    rows = videos.select(F.substring(name, 1, 2).alias("shard"), name.alias("name"), content.alias("content")).repartition("shard")
    write_files(rows.select(F.concat(F.lit("shard="), "shard", F.lit("/"), "name", F.lit(".json")).alias("path"), "content"), root, mode)


def summary(results: DataFrame, config: dict, elapsed_sec: float | None = None, manifest_path: str | None = None, video_root: str | None = None) -> DataFrame:
    """One row: where the questions and videos came from, how many there were, accuracy, and the settings as JSON.

    The rows themselves lie beside it (``write_results``), as they may be many.
    """
    import json

    out = results.agg(
        F.count_distinct("url" if "url" in results.columns else "video_key").alias("videos"),
        F.count(F.lit(1)).alias("question_count"),
        F.coalesce(F.avg(F.col("choice_correct").cast("double")), F.lit(0.0)).alias("choice_accuracy"),
    )
    paths = [F.lit(v).cast("string").alias(k) for k, v in (("manifest_path", manifest_path), ("video_root", video_root))]
    return out.select(*paths, "*", F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"), F.lit(elapsed_sec).cast("double").alias("elapsed_sec"))


def write_summary(results: DataFrame, config: dict, path: str, elapsed_sec: float | None = None, manifest_path: str | None = None, video_root: str | None = None) -> DataFrame:
    """The summary as JSON; returned as read back."""
    out = summary(results, config, elapsed_sec, manifest_path, video_root)
    out.coalesce(1).write.mode("overwrite").json(path)
    return results.sparkSession.read.schema(out.schema).json(path)


def manifest_document(videos: DataFrame, stats: DataFrame, **settings) -> dict:
    """A sampled manifest as one document; the caller passes a sample, so it is small."""
    counts: dict[str, object] = {}
    for r in stats.orderBy("stat", "key").collect():
        if r["key"] == "" and r["stat"].endswith("_count"):
            counts[r["stat"]] = r["n"]
        else:
            counts.setdefault(r["stat"], {})[r["key"]] = r["n"]
    rows = [r.asDict(recursive=True) for r in videos.orderBy("video_id", "url").collect()]
    named = dict.fromkeys(("source_json", "source_dataset", "source_split", "sample_size", "seed", "bucket_fields", "duration_quota", "video_root"))
    flags = {"validate_downloadable": False, "allow_download": False, "replacements": []}
    return {**named, **flags, **settings, "stats": counts, "videos": rows}


def png(image: Row) -> bytes:
    """An image struct (blue-green-red, grey, or with an opacity that is dropped) as a PNG file."""
    import struct
    import zlib

    import numpy as np

    h, w, c = image["height"], image["width"], image["nChannels"]
    pixels = np.frombuffer(image["data"], np.uint8).reshape(h, w, c)
    pixels = pixels if c == 1 else pixels[..., 2::-1]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def from_png(content: bytes) -> tuple[int, int, int, bytes]:
    """(height, width, channels, bytes in blue-green-red order) of a PNG file with 8 bits a channel, grey or in colours, with or without opacity."""
    import struct
    import zlib

    import numpy as np

    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        head, body = data if kind == b"IHDR" else head, body + data if kind == b"IDAT" else body
        at += size + 12
    w, h, depth, colour, *_, laced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (0, 2, 4, 6) or laced:
        raise ValueError("only PNG files of 8 bits a channel without a palette or interlacing")
    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.uint8)  # a line above and a pixel before that are zero
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].reshape(w, c)
        above = out[y]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = line + above[1:]
        else:
            for x in range(1, w + 1):
                a, b, d = out[y + 1, x - 1].astype(np.int16), above[x].astype(np.int16), above[x - 1].astype(np.int16)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    guess = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, d))
                out[y + 1, x] = (line[x - 1] + guess).astype(np.uint8)
    pixels = out[1:, 1:]
    if c == 2:
        pixels = pixels[..., [0, 0, 0, 1]]
    elif c > 2:
        pixels = pixels[..., [2, 1, 0, 3][:c]]
    return h, w, pixels.shape[2], pixels.tobytes()


def png_writer(root: str) -> Callable[[Row], None]:
    """For ``export_frames``: <root>/<video>/<question>/evidence_frames/<name>.png, in any store that pyarrow reaches."""

    def write(row: Row) -> None:
        import os

        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        path = f"{base}/{row['video_key']}/{row['question_id']}/evidence_frames/{row['file_name']}"
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(png(row["image"]))

    return write


def frame_names(evidence: DataFrame) -> DataFrame:
    """Adds file_name, from position and time."""
    return evidence.withColumn("file_name", F.concat(frame_tag(F.col("position"), F.col("time_sec")), F.lit(".png")))


def export_frames(evidence: DataFrame, images: DataFrame, write: Callable[[Row], None]) -> None:
    """Hand each evidence frame (video_key, question_id, file_name, image) to ``write`` in the worker that has it."""
    rows = frame_names(evidence).join(images.select("video_key", F.col("frame_ordinal").alias("frame_index"), "image"), ["video_key", "frame_index"])

    def each(part: Iterable[Row]) -> None:
        for row in part:
            write(row)

    rows.foreachPartition(each)


def write_evidence(evidence: DataFrame, images: DataFrame, root: str, mode: str = "append") -> None:
    """Evidence frames as <root>/<video>/<question>/evidence_frames/<name>.png, by the sink that commits (``files``)."""
    from chronoreel.sources.files import write_files

    @F.pandas_udf("binary")
    def encoded(image: pd.DataFrame) -> pd.Series:
        return pd.Series([png(row) for row in image.to_dict("records")], dtype=object)

    rows = frame_names(evidence).join(images.select("video_key", F.col("frame_ordinal").alias("frame_index"), "image"), ["video_key", "frame_index"])
    path = F.concat_ws("/", "video_key", "question_id", F.lit("evidence_frames"), "file_name")
    # A question's frames are few; a video's folders are one task's, so each video is one move at the commit.
    write_files(rows.repartition("video_key").select(path.alias("path"), encoded("image").alias("content")), root, mode)


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """(video_key, question_id, file_name, image) of the frames that ``write_evidence`` left, listed and read in tasks."""
    from chronoreel.sources.files import contents, list_files

    parts = F.split("path", "/")

    @F.pandas_udf("height int, width int, nChannels int, data binary")
    def decoded(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([from_png(x) for x in content], columns=["height", "width", "nChannels", "data"])

    found = contents(list_files(spark, root, 3).where(F.element_at(parts, -2) == "evidence_frames"), root)
    return found.select(F.element_at(parts, -4).alias("video_key"), F.element_at(parts, -3).alias("question_id"), F.element_at(parts, -1).alias("file_name"), decoded("content").alias("image"))


def exported_counts(spark: SparkSession, root: str) -> DataFrame:
    """(video_key, question_id, n_frames) of the folders that ``write_evidence`` left; an empty one has 0."""
    from chronoreel.sources.files import list_folders

    found = list_folders(spark, root, 3)
    parts = F.split("path", "/")
    return found.where(F.element_at(parts, -1) == "evidence_frames").select(F.element_at(parts, -3).alias("video_key"), F.element_at(parts, -2).alias("question_id"), F.col("n_files").alias("n_frames"))


def _write_raw(frames: DataFrame, root: str, mode: str) -> None:
    """Frames (path, at, fps, image, part) as raw videos, a file for each path; its frames, in the order of ``at``, stream through one task.

    Files of one ``part`` are written by the same task. The first frame of a file brings the head, so frames are gone through once.
    """
    from chronoreel.sources.files import write_files

    head = F.format_string("%s %d %d %d\n", F.col("fps").cast("string"), "image.height", "image.width", "image.nChannels").cast("binary")
    first = F.row_number().over(Window.partitionBy("part", "path").orderBy("at")) == 1
    data = F.coalesce("image.data", F.lit(b""))
    rows = frames.repartition("part").select("part", "path", "at", F.when(first, F.concat(head, data)).otherwise(data).alias("content"))
    write_files(rows.sortWithinPartitions("part", "path", "at"), root, mode)


def write_raw_videos(frames: DataFrame, root: str, mode: str = "append") -> None:
    """Native frames (video_key, native_index, native_fps, image) as <root>/<video>.raw, which ``raw`` reads."""
    path = F.concat("video_key", F.lit(".raw"))
    _write_raw(frames.select(path.alias("path"), F.col("native_index").alias("at"), F.col("native_fps").alias("fps"), "image", path.alias("part")), root, mode)


def write_raw_clips(segments: DataFrame, images: DataFrame, root: str, fps: float, max_segments: int | None = None, mode: str = "append") -> None:
    """The first ``max_segments`` segments of each level as <root>/<video>/<segment_id>.raw, both boundary frames included.

    Clips go to tasks by CLIPS of a video, so a video with few is one move at the commit and one with many is no single task's.
    """
    from chronoreel.operators.segments import frames_of

    some = segments if max_segments is None else segments.where(F.col("segment_no") < max_segments)
    rows = frames_of(some, "segment_id").join(images.select("video_key", "frame_ordinal", "image"), ["video_key", "frame_ordinal"])
    path, part = F.concat("video_key", F.lit("/"), "segment_id", F.lit(".raw")), F.concat_ws("/", "video_key", F.floor(F.col("segment_no") / CLIPS).cast("string"))
    _write_raw(rows.select(path.alias("path"), F.col("frame_ordinal").alias("at"), F.lit(float(fps)).alias("fps"), "image", part.alias("part")), root, mode)


def export_clips(segments: DataFrame, images: DataFrame, write: Callable[[tuple, Iterable[Row]], None], max_segments: int | None = None) -> None:
    """Hand each segment's frames, in order, to ``write(key, rows)``; rows stream, so a clip need not fit in memory."""
    from itertools import groupby

    from chronoreel.operators.segments import frames_of

    some = segments if max_segments is None else segments.where(F.col("segment_no") < max_segments)
    key = ["video_key", "level", "segment_no"]
    rows = frames_of(some).join(images.select("video_key", "frame_ordinal", "image"), ["video_key", "frame_ordinal"])

    def each(part: Iterable[Row]) -> None:
        for k, group in groupby(part, lambda r: (r["video_key"], r["level"], r["segment_no"])):
            write(k, group)

    rows.repartition(*key).sortWithinPartitions(*key, "frame_ordinal").foreachPartition(each)


SIGNALS = ("energy", "openclip", "dino", "combined")


def decimated(signals: DataFrame, width: int, names: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(video_key, signal, pixel, frame_ordinal, time_sec, value): what a plot ``width`` pixels wide can show of each signal.

    Of each pixel column the frames with its least and its greatest value, of equal ones the first; so at most
    2 * ``width`` rows a video and signal, and all frames where a column has no more than two. One aggregate, which combines
    before the shuffle. Null and NaN values are left out.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    ends = signals.groupBy("video_key").agg(F.min("time_sec").cast("double").alias("t0"), F.max("time_sec").cast("double").alias("t1"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
    rows = signals.join(ends, "video_key").select("video_key", "frame_ordinal", F.col("time_sec").cast("double").alias("time_sec"), "t0", "t1", each).select("*", "x.*").drop("x")
    share = F.when(F.col("t1") > F.col("t0"), (F.col("time_sec") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(F.lit(0.0))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("pixel", F.least(F.floor(share * width), F.lit(width - 1)).cast("int"))
    low, high = F.struct("value", "frame_ordinal", "time_sec"), F.struct("value", (-F.col("frame_ordinal")).alias("back"), "time_sec")
    found = rows.groupBy("video_key", "signal", "pixel").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    both = F.array_distinct(F.array(F.col("low"), F.struct(F.col("high.value").alias("value"), (-F.col("high.back")).alias("frame_ordinal"), F.col("high.time_sec").alias("time_sec"))))
    return found.select("video_key", "signal", "pixel", F.explode(both).alias("p")).select("video_key", "signal", "pixel", "p.frame_ordinal", "p.time_sec", "p.value")


def signal_panels(signals: DataFrame, video_key: str, width: int = 2000) -> list[tuple[str, list[float], list[float]]]:
    """What a plot of one video shows: (name, times, values) for energy, openclip, dino and combined; at most 2 * ``width`` points each."""
    rows = decimated(signals.where(F.col("video_key") == video_key), width).orderBy("signal", "frame_ordinal").collect()
    return [(c, [r["time_sec"] for r in rows if r["signal"] == c], [r["value"] for r in rows if r["signal"] == c]) for c in SIGNALS]


def plot_signals(signals: DataFrame, video_key: str, path: str) -> None:
    """Four panels as an image; needs matplotlib."""
    try:
        import matplotlib
    except ImportError as e:
        raise RuntimeError("plot_signals needs matplotlib") from e
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    figure, axes = plt.subplots(4, 1, sharex=True, figsize=(12, 8))
    for axis, (name, times, values) in zip(axes, signal_panels(signals, video_key), strict=True):
        axis.plot(times, values)
        axis.set_ylabel(name)
    axes[-1].set_xlabel("seconds")
    figure.savefig(path)
    plt.close(figure)
