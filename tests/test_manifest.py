import json
import random

import pytest
from pyspark.sql import functions as F

from chronoreel import schemas
from chronoreel.operators import evaluate, inference, manifest, sampling
from chronoreel.sources import frames as frame_source
from chronoreel.sources import sinks
from chronoreel.sources.manifest import read_manifest, read_question_table

FLAT = [
    {"video_id": "001", "duration": "short", "domain": "d1", "sub_category": "s", "url": "https://www.youtube.com/watch?v=abc", "question_id": q, "task_type": t, "question": "Q", "options": ["A. x"], "answer": "A"}
    for q, t in (("001-2", "x"), ("001-10", "y"))
] + [{"video_id": "002", "duration": "long", "domain": "d1", "sub_category": "s", "url": "u", "videoID": "zzz", "question_id": "002-1", "task_type": "x", "question": "Q", "options": [], "answer": "B"}]


def test_read_flat_nested_and_object(spark, tmp_path):
    for name, document in (("flat", FLAT), ("nested", None), ("object", None)):
        path = tmp_path / f"{name}.json"
        if document is None:
            nested = [{"video_id": "9", "duration": "short", "domain": "d", "sub_category": "s", "url": "https://watch?v=kept", "questions": [{"question_id": "9-1", "task_type": "x", "question": "Q", "options": ["A. x"], "answer": "A"}]}, {"video_id": "8", "duration": "short", "domain": "d", "sub_category": "s", "url": "b"}]
            document = nested if name == "nested" else {"videos": nested}
        path.write_text(json.dumps(document))
        videos = read_manifest(spark, str(path)).orderBy("row_no").collect()
        if name == "flat":
            assert [(v["video_id"], v["url"]) for v in videos] == [("001", "abc"), ("002", "zzz")]
            assert [q["question_id"] for q in videos[0]["questions"]] == ["001-10", "001-2"]
        else:
            assert [(v["url"], len(v["questions"])) for v in videos] == [("https://watch?v=kept", 1), ("b", 0)]
    spark.createDataFrame([{"videoID": None, **r} for r in FLAT], schemas.FLAT_ROW).write.parquet(str(tmp_path / "flat"))
    assert sorted((v["video_id"], v["url"]) for v in read_question_table(spark, str(tmp_path / "flat")).collect()) == [("001", "abc"), ("002", "zzz")]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="not a manifest"):
        read_manifest(spark, str(tmp_path / "bad.json"))


def test_stats_and_targets(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(FLAT))
    videos = read_manifest(spark, str(tmp_path / "m.json"))
    got = {(r["stat"], r["key"]): r["n"] for r in manifest.stats(videos).collect()}
    assert got[("video_count", "")] == 2 and got[("question_count", "")] == 3
    assert got[("by_duration_domain", "long | d1")] == 1 and got[("by_task_type", "x")] == 2
    empty = {(r["stat"], r["key"]): r["n"] for r in manifest.stats(videos.limit(0)).collect()}
    assert empty == {("video_count", ""): 0, ("question_count", ""): 0}
    assert [r["url"] for r in manifest.select_targets(videos, ["zzz", "no", "abc"]).collect()] == ["zzz", "abc"]
    assert manifest.select_targets(videos, []).count() == 2
    document = sinks.manifest_document(videos, manifest.stats(videos), sample_size=2)
    assert document["source_json"] is None and document["stats"]["by_domain"] == {"d1": 2}


def strata(spark, size, sizes):
    rows = [(f"b{i:02d}", n, i, size) for i, n in enumerate(sizes)]
    got = sampling.stratum_targets(spark.createDataFrame(rows, "bucket string, n long, first int, size int")).orderBy("first").collect()
    return [r["target"] for r in got]


@pytest.mark.parametrize(
    ("size", "sizes", "targets"),
    [(10, [12, 3, 3, 3, 3], [5, 2, 1, 1, 1]), (8, [33, 33, 34], [2, 2, 4]), (10, [40, 40, 1, 1, 1, 1], [2, 4, 1, 1, 1, 1]), (6, [40, 1, 1, 1, 1], [2, 1, 1, 1, 1]), (50, [58, 42], [29, 21]), (9, [2, 3], [2, 3]), (0, [2, 3], [0, 0])],
)
def test_stratum_targets(spark, size, sizes, targets):
    assert strata(spark, size, sizes) == targets


def test_stratum_targets_always_add_up(spark):
    rng = random.Random(2)
    rows = []
    for g in range(300):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 8))]
        size = rng.randint(len(sizes), sum(sizes))
        rows += [(g, i, n, size) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g int, first int, n long, size int")
    sums = sampling.stratum_targets(df, ["g"]).groupBy("g").agg(F.sum("target").alias("t"), F.max("size").alias("s"), F.min("target").alias("least"), F.max(F.col("target") - F.col("n")).alias("over"))
    assert all(r["t"] == r["s"] and r["least"] >= 1 and r["over"] <= 0 for r in sums.collect())


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(f"{i:03d}", "short" if i % 3 else "long", f"d{i % 2}", f"u{i:03d}", i) for i in range(60)]
    return spark.createDataFrame(rows, "video_id string, duration string, domain string, url string, row_no int").cache()


def test_samples(spark, catalogue):
    drawn = sampling.stratified_sample(catalogue, 10, 7)
    assert drawn.count() == 10 and drawn.select("url").distinct().count() == 10
    assert sorted(r["url"] for r in drawn.collect()) == sorted(r["url"] for r in sampling.stratified_sample(catalogue.repartition(7), 10, 7).collect())
    by = {r["duration"]: r["count"] for r in sampling.quota_sample(catalogue, {"short": 7, "long": 3}).groupBy("duration").count().collect()}
    assert by == {"short": 7, "long": 3}
    with pytest.raises(ValueError, match="cannot cover"):
        sampling.stratified_sample(catalogue, 3)
    with pytest.raises(ValueError, match="quota 99"):
        sampling.quota_sample(catalogue, {"short": 99})


def test_replacement(spark, catalogue):
    drawn = sampling.stratified_sample(catalogue, 10, 7).cache()
    gone = [r["url"] for r in drawn.orderBy("url").limit(3).collect()]
    here = catalogue.where(~F.col("url").isin(gone)).select("url")
    out, log = sampling.validate_and_replace(drawn, catalogue, here, 7)
    assert out.count() == 10 and not set(gone) & {r["url"] for r in out.collect()}
    before = {r["url"]: (r["duration"], r["domain"]) for r in catalogue.collect()}
    assert all(before[r["replaced_url"]] == before[r["replacement_url"]] for r in log.collect()) and log.count() == 3
    with pytest.raises(RuntimeError, match="left to replace"):
        sampling.validate_and_replace(drawn, catalogue, drawn.where(~F.col("url").isin(gone)).select("url"), 7)


def test_accuracy(spark):
    rows = [("A", "A"), ("none", "A"), ("B", "A")]
    got = evaluate.accuracy(evaluate.judged(spark.createDataFrame(rows, "raw_text string, gold_letter string"))).first()
    assert got["n_questions"] == 3 and abs(got["choice_accuracy"] - 1 / 3) < 1e-12
    empty = evaluate.judged(spark.createDataFrame([], "raw_text string, gold_letter string"))
    assert evaluate.accuracy(empty).first()["choice_accuracy"] == 0.0


def test_raw_videos_to_clips(spark, tmp_path):
    body = bytes(range(12)) * 30
    (tmp_path / "one.raw").write_bytes(b"8.0 2 2 3\n" + body)
    out = frame_source.sample_videos(spark, str(tmp_path), frame_source.raw_decoder, 4.0).orderBy("frame_ordinal").collect()
    assert [r["native_index"] for r in out] == list(range(0, 30, 2)) and out[3]["time_sec"] == 0.75 and out[0]["video_key"] == "one"
    df = frame_source.sample_videos(spark, str(tmp_path), frame_source.raw_decoder, 4.0)
    clips = inference.encode_clips(df.select("video_key", "frame_ordinal", F.col("image.data").alias("image")), inference.StubEncoder, 8).collect()
    assert len(clips) == 1 and len(clips[0]["embedding"]) == 16
    names = frame_source.availability(spark, str(tmp_path), ".raw").collect()
    assert [r["url"] for r in names] == ["one"]


def test_encode_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, text string")
    got = inference.encode(df, "text", inference.StubEncoder, 2).orderBy("id").collect()
    assert got[1]["embedding"] is None and got[0]["embedding"] == got[2]["embedding"]
    assert inference.encode(df.limit(0), "text", inference.StubEncoder).count() == 0


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([("u", "1", True), ("u", "2", False)], "url string, question_id string, choice_correct boolean")
    sinks.write_results(results, str(tmp_path / "r"))
    assert (tmp_path / "r" / "url=u" / "question_id=2").is_dir()
    sinks.write_summary(results, {"a": 1}, str(tmp_path / "s"), 1.5)
    assert spark.read.json(str(tmp_path / "s")).first()["choice_accuracy"] == 0.5


def test_png(spark, tmp_path):
    import zlib

    image = {"height": 2, "width": 1, "nChannels": 3, "data": bytes([1, 2, 3, 4, 5, 6])}
    data = sinks.png(image)
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND" + (0xAE426082).to_bytes(4, "big"))
    body = data[data.index(b"IDAT") + 4 : -16]
    assert zlib.decompress(body) == bytes([0, 3, 2, 1, 0, 6, 5, 4])
    evidence = spark.createDataFrame([("v", "q", 0, 4, 1.0)], "video_key string, question_id string, position int, frame_index int, time_sec double")
    schema = "video_key string, frame_ordinal int, image struct<height: int, width: int, nChannels: int, data: binary>"
    images = spark.createDataFrame([("v", 4, (2, 1, 3, bytearray(image["data"])))], schema)
    sinks.export_frames(evidence, images, sinks.png_writer(f"file://{tmp_path}"))
    assert (tmp_path / "v" / "q" / "evidence_frames" / "00_1_00s.png").read_bytes() == data
