"""The sink that commits, folders as tables, raw videos as a data source."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from chronoreel.sources import files, raw, sinks


def tree(root):
    root = Path(root)
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.startswith("_")}


def content(spark, *names, parts=3):
    return spark.createDataFrame([(n, n.encode()) for n in names], "path string, content binary").repartition(parts, "path")


def test_files_are_written_appended_and_overwritten(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    files.write_files(content(spark, "a/1.txt", "a/2.txt", "b/c/3.txt", "top.txt"), root)
    files.write_files(content(spark, "a/4.txt", "d/5.txt"), root)
    want = {"a/1.txt", "a/2.txt", "a/4.txt", "b/c/3.txt", "d/5.txt", "top.txt"}
    assert tree(tmp_path / "out") == {n: n.encode() for n in want}
    assert (tmp_path / "out/_SUCCESS").read_text() == "2" and not (tmp_path / "out/_attempts").exists()
    files.write_files(content(spark, "z.txt"), root, "overwrite")
    assert set(tree(tmp_path / "out")) == {"z.txt"}
    rows = spark.createDataFrame([("one", 1, b"x"), ("one", 2, None), ("one", 3, b"yz"), ("two", 1, b"")], "path string, at int, content binary")
    files.write_files(rows.coalesce(1).sortWithinPartitions("path", "at"), root)
    assert tree(tmp_path / "out") == {"z.txt": b"z.txt", "one": b"xyz", "two": b""}


@pytest.mark.parametrize("names", [("a/1.txt", "../out.txt"), ("/abs",), ("_hidden",), ("a", "b", "a")])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, names):
    root = str(tmp_path / "out")
    files.write_files(content(spark, "kept.txt"), root)
    rows = content(spark, *names) if len(set(names)) == len(names) else spark.createDataFrame([(n, b"") for n in names], "path string, content binary").coalesce(1)
    with pytest.raises(Exception, match="not a path of one file"):
        files.write_files(rows, root, "overwrite")
    assert tree(root) == {"kept.txt": b"kept.txt"} and not (tmp_path / "out/_attempts").exists()


def test_what_is_there_stays(spark, tmp_path):
    root = str(tmp_path / "out")
    files.write_files(content(spark, "a/1.txt"), root)
    with pytest.raises(Exception, match="is there already"):
        files.write_files(spark.createDataFrame([("a/0.txt", b"new"), ("a/1.txt", b"new")], "path string, content binary"), root)
    twice = spark.createDataFrame([("b.txt", b"1")], "path string, content binary")
    with pytest.raises(Exception, match="is written twice"):
        files.write_files(twice.unionAll(twice), root)
    assert tree(root) == {"a/1.txt": b"a/1.txt"}


RETRY = """
import os, sys
sys.path.insert(0, sys.argv[2])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from chronoreel.sources import files

mark = sys.argv[1] + "/failed"

@F.udf("binary")
def once(name):
    if name == "f/7" and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost executor")
    return name.encode()

rows = spark.range(10, numPartitions=2).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"))
files.write_files(rows.withColumn("content", once("path")), sys.argv[1] + "/out")
"""


def test_a_task_that_fails_once_leaves_each_file_once(tmp_path):
    """The second attempt of the task succeeds; what the first had written (files 5 and 6) is not left or doubled."""
    repo = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", RETRY, str(tmp_path), repo], check=True, timeout=240, capture_output=True)
    assert (tmp_path / "failed").exists()
    assert tree(tmp_path / "out") == {f"f/{i}": f"f/{i}".encode() for i in range(10)}
    assert (tmp_path / "out/_SUCCESS").read_text() == "10" and not (tmp_path / "out/_attempts").exists()


def test_folders_are_counted_and_empty_ones_have_none(spark, tmp_path):
    for name in ("v1/q1/evidence_frames/00.png", "v1/q1/evidence_frames/01.png", "v1/q2/evidence_frames/00.png", "v2/q1/other/x.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    (tmp_path / "v3/q9/evidence_frames").mkdir(parents=True)
    (tmp_path / "_attempts/a/b").mkdir(parents=True)
    want = {("v1", "q1", 2), ("v1", "q2", 1), ("v3", "q9", 0)}
    assert {tuple(r) for r in sinks.exported_counts(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in sinks.exported_counts(spark, f"file://{tmp_path}").collect()} == want
    assert sinks.exported_counts(spark, str(tmp_path / "not there")).count() == 0


def video(path, fps, frames, h=2, w=2, c=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(f"{fps} {h} {w} {c}\n".encode() + b"".join(bytes([i % 256] * (h * w * c)) for i in range(frames)))


@pytest.mark.parametrize("range_bytes", [7, 50, 64 << 20])
def test_raw_videos_as_a_source(spark, tmp_path, range_bytes):
    rates = {"a": (30, 50), "b": (10.0, 9), "c": (1, 3), "deep/d": (29.97, 33)}
    for key, (fps, n) in rates.items():
        video(tmp_path / f"{key}.raw", fps, n)
    (tmp_path / "_SUCCESS").touch()
    df = raw.raw_videos(spark, str(tmp_path), 4.0, range_bytes=range_bytes)
    got = {(r["video_key"], r["frame_ordinal"], r["native_index"], round(r["time_sec"], 4), bytes(r["image"]["data"])) for r in df.collect()}
    steps = {k: max(round(float(fps) / 4), 1) for k, (fps, _) in rates.items()}
    want = {(k, i // steps[k], i, round(i / fps, 4), bytes([i] * 4)) for k, (fps, n) in rates.items() for i in range(0, n, steps[k])}
    assert got == want and df.count() == len(want)
    if range_bytes == 7:
        assert df.rdd.getNumPartitions() > 20
    some = df.where((F.col("video_key").isin("a", "b", "x")) & (F.col("native_index") > 3) & (F.col("frame_ordinal") <= 4))
    assert {(r["video_key"], r["native_index"]) for r in some.collect()} == {(k, i) for k, o, i, _, _ in want if k in "ab" and i > 3 and o <= 4}
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("PushedFilters", "")
    plain = raw.raw_videos(spark, f"file://{tmp_path}", 4.0, images=False)
    assert "image" not in plain.columns and plain.count() == len(want)


def test_pushed_filters_and_stride_read_fewer_frames(tmp_path, monkeypatch):
    video(tmp_path / "a.raw", 40, 100)
    video(tmp_path / "b.raw", 40, 100)
    read = []
    frame = raw.RawReader._frame
    monkeypatch.setattr(raw.RawReader, "_frame", lambda self, file, at, *size: read.append(at) or frame(self, file, at, *size))

    def rows(fps, *filters):
        read.clear()
        reader = raw.RawReader(str(tmp_path), fps, True, 60)
        rest = list(reader.pushFilters(list(filters)))
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), len(read), len(rest)

    assert rows(100.0) == (200, 200, 0)
    assert rows(4.0) == (20, 20, 0)
    assert rows(4.0, D.EqualTo(("video_key",), "b"), D.LessThan(("frame_ordinal",), 3), D.IsNotNull(("video_key",))) == (3, 3, 0)
    assert rows(4.0, D.In(("video_key",), ("a", None)), D.StringContains(("video_key",), "x"), D.GreaterThanOrEqual(("time_sec",), 2.0)) == (2, 2, 1)


@pytest.mark.parametrize("bad", [b"", b"nonsense", b"30 2 2 1\nab", b"0 2 2 1\n1234"])
def test_files_that_are_no_video_are_refused(spark, tmp_path, bad):
    (tmp_path / "a.raw").write_bytes(bad)
    with pytest.raises(Exception, match="not a raw video|no frames|must be positive"):
        raw.raw_videos(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFound|not there"):
        raw.raw_videos(spark, str(tmp_path / "not there")).collect()


def test_videos_and_clips_come_back(spark, tmp_path):
    rows = [(v, i, 10.0, {"height": 1, "width": 2, "nChannels": 1, "data": bytearray([k, i])}) for k, v in enumerate(("x", "y")) for i in range(40)]
    df = spark.createDataFrame(rows, f"video_key string, native_index bigint, native_fps double, {raw.IMAGE}").repartition(4)
    sinks.write_raw_videos(df, str(tmp_path / "videos"))
    back = raw.raw_videos(spark, str(tmp_path / "videos"), float("inf"))
    assert {(r["video_key"], r["native_index"], bytes(r["image"]["data"])) for r in back.collect()} == {(v, i, bytes(x["data"])) for v, i, _, x in rows}
    cut = spark.createDataFrame([("x", "low", 0, "low_0000", 0, 5), ("x", "low", 1, "low_0001", 5, 9), ("y", "low", 2, "low_0002", 3, 4)], "video_key string, level string, segment_no int, segment_id string, start_index int, end_index int")
    sinks.write_raw_clips(cut, df.withColumnRenamed("native_index", "frame_ordinal"), str(tmp_path / "clips"), 4.0, max_segments=2)
    clips = raw.raw_clips(spark, str(tmp_path / "clips"))
    assert {(r["video_key"], r["clip"], r["frame_ordinal"], r["image"]["data"][1]) for r in clips.collect()} == {("x", "low_0000", i, i) for i in range(6)} | {("x", "low_0001", i, 5 + i) for i in range(5)}
