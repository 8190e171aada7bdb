"""Many small files: folders as one move, names dealt to tasks, files read where their names are."""

import gzip
import json
import random
import struct
import zlib

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from chronoreel import schemas
from chronoreel.sources import files, manifest, sinks


def touch(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())


def test_a_folder_that_one_task_wrote_is_one_move(tmp_path):
    touch(tmp_path, *(f"0/v{v}/q/{i}" for v in range(3) for i in range(20)), "1/w/q/1", "1/both/q/1", "0/both/q/2", "0/there/2")
    touch(tmp_path / "base", "there/1")
    base = str(tmp_path / "base")
    folders = []
    moves = files.CommittingWriter(base, False)._moves(pyarrow.fs.LocalFileSystem(), [f"{tmp_path}/0", f"{tmp_path}/1"], base, True, folders)
    got = sorted(to.removeprefix(base) for _, to in moves)
    assert got == ["/both/q/1", "/both/q/2", "/there/2", "/v0", "/v1", "/v2", "/w"]
    assert folders == [f"{base}/both", f"{base}/both/q"]


def test_names_are_dealt_to_all_tasks(spark, tmp_path):
    touch(tmp_path, *(f"v{v}/q/evidence_frames/{i}.png" for v in range(40) for i in range(2)))
    counts = sinks.exported_counts(spark, str(tmp_path))
    assert {r["n_frames"] for r in counts.collect()} == {2} and counts.count() == 40
    assert counts.select(F.spark_partition_id()).distinct().count() == 4
    found = files.contents(files.list_files(spark, f"file://{tmp_path}", 3), f"file://{tmp_path}")
    assert all(r["path"].encode() == b"/" + bytes(r["content"]) for r in found.collect()) and found.count() == 80
    assert found.select(F.spark_partition_id()).distinct().count() == 4
    assert files.list_files(spark, str(tmp_path / "not there"), 2).count() == 0


def test_evidence_is_read_as_the_image_reader_does(spark, tmp_path):
    rng = random.Random(1)
    rows = [(v, i, {"height": 2, "width": 3, "nChannels": c, "data": bytearray(rng.randbytes(6 * c))}) for v, c in (("a", 1), ("b", 3)) for i in range(3)]
    images = spark.createDataFrame(rows, "video_key string, frame_ordinal int, image struct<height:int,width:int,nChannels:int,data:binary>")
    evidence = images.select("video_key", F.lit("q").alias("question_id"), F.col("frame_ordinal").alias("position"), F.col("frame_ordinal").alias("frame_index"), F.lit(0.5).alias("time_sec"))
    sinks.write_evidence(evidence, images, str(tmp_path / "out"))
    columns = ("height", "width", "nChannels", "data")
    got = sinks.read_evidence(spark, str(tmp_path / "out")).select("video_key", "question_id", "file_name", *[f"image.{c}" for c in columns]).collect()
    back = spark.read.format("image").load(f"{tmp_path}/out/*/*/evidence_frames").select("image.*").collect()
    want = {(*(p := r["origin"].split("/"))[-4:-2], p[-1], *(r[c] for c in columns[:3]), bytes(r["data"])) for r in back}
    assert {(*r[:6], bytes(r["data"])) for r in got} == want and len(got) == 6


@pytest.mark.parametrize("c,colour", [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_all_filters_of_png_files(c, colour):
    rng = np.random.default_rng(c)
    h, w = 10, 7
    pixels = rng.integers(0, 256, (h, w, c)).astype(np.int16)
    above, before = np.zeros_like(pixels), np.zeros_like(pixels)
    above[1:], before[:, 1:] = pixels[:-1], pixels[:, :-1]
    corner = np.zeros_like(pixels)
    corner[1:, 1:] = pixels[:-1, :-1]
    p, q, r = abs(above - corner), abs(before - corner), abs(above + before - 2 * corner)
    paeth = np.where((p <= q) & (p <= r), before, np.where(q <= r, above, corner))
    guesses = [0 * pixels, before, above, (before + above) // 2, paeth]
    lines = b"".join(bytes([y % 5]) + ((pixels[y] - guesses[y % 5][y]) % 256).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(lines)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", body[:20]) + chunk(b"IDAT", body[20:]) + chunk(b"IEND", b"")
    order = {1: [0], 3: [2, 1, 0], 2: [0, 0, 0, 1], 4: [2, 1, 0, 3]}[c]
    assert sinks.from_png(png) == (h, w, len(order), pixels[..., order].astype(np.uint8).tobytes())
    with pytest.raises(ValueError, match="not a PNG"):
        sinks.from_png(b"GIF89a")


def test_small_raw_files_are_many_tasks(spark, tmp_path):
    from chronoreel.sources import raw

    for i in range(3 * raw.FILES):
        (tmp_path / f"{i}.raw").write_bytes(b"1 1 1 1\n\x07")
    assert len(raw.RawReader(str(tmp_path), 4.0, True, raw.RANGE_BYTES).partitions()) >= 3


def test_clips_are_written_in_one_pass_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from chronoreel.sources import raw

    rows = [(v, i, {"height": 1, "width": 2, "nChannels": 1, "data": bytearray([k, i])}) for k, v in enumerate("abcdefgh") for i in range(9)]
    images = spark.createDataFrame(rows, f"video_key string, frame_ordinal int, {raw.IMAGE}")
    cut = spark.createDataFrame([(v, "low", n, f"low_{n:04d}", n, n + 2) for v in "abcdefgh" for n in range(6)], "video_key string, level string, segment_no int, segment_id string, start_index int, end_index int")
    plans = []
    write = files.write_files
    monkeypatch.setattr(files, "write_files", lambda rows, *more: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, *more))
    sinks.write_raw_clips(cut, images, str(tmp_path / "clips"), 4.0)
    assert plans[0].count("Join") == 1
    clips = raw.raw_clips(spark, f"file://{tmp_path}/clips/")
    assert sorted((r["video_key"], r["clip"], r["frame_ordinal"], bytes(r["image"]["data"])) for r in clips.collect()) == [(v, f"low_{n:04d}", i, bytes([k, n + i])) for k, v in enumerate("abcdefgh") for n in range(6) for i in range(3)]
    assert clips.select(F.spark_partition_id()).distinct().count() == 4
    with pytest.raises(FileNotFoundError):
        raw.raw_clips(spark, str(tmp_path / "not there"))


def video(i, n=2):
    questions = [{"question_id": f"{i}-{k}", "task_type": "x", "question": f"Q \u00e9 {k}", "options": ["A. x", "B. y"], "answer": "A"} for k in range(n)]
    return {"video_id": f"{i:03d}", "duration": "short", "domain": "d", "sub_category": "s", "url": f"u{i}", "questions": questions}


def test_manifest_documents_are_looked_into_and_read_in_tasks(spark, tmp_path, monkeypatch):
    videos = spark.createDataFrame([json.dumps(video(i)) for i in range(600)], "string").select(F.from_json("value", schemas.NESTED_VIDEO).alias("v")).select("v.*")
    root = tmp_path / "a folder"
    moves = []
    move = files.CommittingWriter._moves
    monkeypatch.setattr(files.CommittingWriter, "_moves", lambda self, *a: moves.extend(found := list(move(self, *a))) or found)
    sinks.write_manifest_files(videos, str(root))
    assert len(list(root.rglob("*.json"))) == 600 and len(moves) <= 256 and {p.name[:6] for p in root.iterdir() if p.is_dir()} == {"shard="}
    by_spark = sorted((r["videos"][0]["url"], len(r["videos"][0]["questions"])) for r in spark.read.option("multiLine", True).json(str(root)).collect())
    monkeypatch.setattr("pyspark.sql.DataFrameReader.json", None)  # its inference opens file after file in few tasks
    back = manifest.read_manifest(spark, str(root))
    rows = back.collect()
    assert {(r["url"], r["questions"][1]["question"], len(r["questions"])) for r in rows} == {(f"u{i}", "Q \u00e9 1", 2) for i in range(600)} and len(rows) == len(by_spark) == 600
    assert by_spark == sorted((r["url"], len(r["questions"])) for r in rows)
    assert back.select(F.spark_partition_id()).distinct().count() == 4
    assert [r["row_no"] for r in rows] == [r["row_no"] for r in back.collect()] and len({r["row_no"] for r in rows}) == 600
    with pytest.raises(Exception, match="is there already"):
        sinks.write_manifest_files(videos.limit(1), str(root))


@pytest.mark.parametrize("form", ["object", "nested", "flat"])
def test_folders_of_manifests_are_read_as_the_json_reader_does(spark, tmp_path, monkeypatch, form):
    def document(*ids):
        found = [video(i, 12) for i in ids]
        flat = [{**{k: v[k] for k in ("video_id", "duration", "domain", "sub_category", "url")}, **q} for v in found for q in v["questions"]]
        return json.dumps({"object": {"videos": found}, "nested": found, "flat": flat}[form], indent=1, ensure_ascii=False)

    for name, content in {
        "plain.json": document(5, 4, 3).encode(), "marked": b"\xef\xbb\xbf" + document(1).encode(), "wide.json": document(2).encode("utf-16"), "packed.json.gz": gzip.compress(document(6, 7).encode()),
        "a=1/b=x/deep.json": document(8).encode(), "a=2/b=y/deep.json": document(9).encode(), "none.json": b"", "blank.json": b" \n", "_SUCCESS": b"3", ".x.json": b"{", "_old/x.json": document(20).encode(),
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {}
    for limit in (manifest.DOCUMENT, 1):
        monkeypatch.setattr(manifest, "DOCUMENT", limit)
        if limit == 1:  # Spark's reader wants files in folders of one depth
            for name in ("plain.json", "marked", "wide.json", "packed.json.gz", "none.json", "blank.json"):
                (tmp_path / "a=1/b=x" / name).write_bytes((tmp_path / name).read_bytes())
                (tmp_path / name).unlink()
        got[limit] = manifest.read_manifest(spark, str(tmp_path)).orderBy("row_no").collect()
    plain, by_spark = got.values()
    assert sorted(r[:6] for r in plain) == sorted(r[:6] for r in by_spark) and sorted(r["video_id"] for r in plain) == [f"{i:03d}" for i in range(1, 10)]
    order = [r["video_id"] for r in plain if r["video_id"] in ("003", "004", "005")]
    assert order == (["003", "004", "005"] if form == "flat" else ["005", "004", "003"])


def test_a_folder_without_documents_is_an_empty_manifest(spark, tmp_path):
    (tmp_path / "_SUCCESS").write_text("0")
    assert manifest.read_manifest(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "bad.json").write_text('{"a": null}')
    with pytest.raises(ValueError, match="not a manifest: it has .'a'"):
        manifest.read_manifest(spark, str(tmp_path))
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match=r"not a manifest: it has \[\]"):
        manifest.read_manifest(spark, str(tmp_path))
    (tmp_path / "bad.json").write_text('{"videos": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        manifest.read_manifest(spark, str(tmp_path)).collect()


def test_a_store_that_only_spark_reads_and_patterns_go_to_its_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"videos": [video(i)]}))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}/in")
    for path in ("viewfs://shelf/in", f"{tmp_path}/in/[0-9].json"):
        assert files.as_folder(spark, path) is None
        assert sorted(r["url"] for r in manifest.read_manifest(spark, path).collect()) == ["u0", "u1", "u2"]
    assert files.as_folder(spark, f"file:{tmp_path}/in/") == f"{tmp_path}/in"
