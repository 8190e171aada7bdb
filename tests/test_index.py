import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoreel.config import IndexConfig, RetrievalConfig
from chronoreel.operators import retrieve, segments, signals
from chronoreel.operators.inference import StubAnswerer
from chronoreel.plans.pipeline import VideoIndex, baseline_frames, build_index, evaluate, evaluate_baseline
from chronoreel.plans.pipeline import retrieve as run_retrieval

FRAME = "video_key string, frame_ordinal int, time_sec float, s float"


def frames(spark, *series, seconds=1.0):
    rows = [(f"v{k}", i, float(i * seconds), float(x)) for k, xs in enumerate(series) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, FRAME)


def cut(df, threshold=0.5, shortest=2.0, longest=None):
    rows = segments.segment_by_threshold(df, threshold, shortest, "low", longest, "s").orderBy("video_key", "segment_no").collect()
    return [(r["video_key"], r["start_index"], r["end_index"], round(r["peak_score"], 4), round(r["mean_score"], 4)) for r in rows]


def test_sampling_step(spark):
    rates = [30.0, 25.0, 24.0, 18.0, 10.0, 1.0, 29.97, 60.0]
    native = spark.createDataFrame([(str(i), n, r) for i, r in enumerate(rates) for n in range(40)], "video_key string, native_index bigint, native_fps double")
    kept = signals.stride(native, 4.0).groupBy("video_key").agg(F.min(F.when(F.col("native_index") > 0, F.col("native_index"))).alias("step"), F.max("frame_ordinal").alias("last"), F.count("*").alias("n"))
    got = {r["video_key"]: r for r in kept.collect()}
    assert [got[str(i)]["step"] for i in range(len(rates))] == [8, 6, 6, 4, 2, 1, 7, 15]
    assert all(r["last"] == r["n"] - 1 for r in got.values())


def test_minmax_and_constant(spark):
    df = frames(spark, [1, 2, 5], [3, 3, 3]).withColumn("m", signals.minmax("s")).orderBy("video_key", "frame_ordinal")
    assert [r["m"] for r in df.collect()] == [0.0, 0.25, 1.0, 0.0, 0.0, 0.0]


def test_drift(spark):
    rows = [("a", i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])] + [("b", 0, [1.0, 0.0]), ("c", 0, [2.0, 0.0]), ("c", 1, [2.0, 0.0])]
    df = signals.cosine_drift(spark.createDataFrame(rows, "video_key string, frame_ordinal int, embedding array<float>")).orderBy("video_key", "frame_ordinal")
    assert [r["drift"] for r in df.collect()] == [0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0]


def test_segmentation_goldens(spark):
    df = frames(spark, [0, 0.9, 0.1, 0.9, 0.9, 0.2], [0] * 6, [0, 0, 0, 0, 0, 0.9], [1])
    assert cut(df) == [("v0", 0, 3, 0.9, 0.475), ("v0", 3, 5, 0.9, 0.6667), ("v1", 0, 5, 0.0, 0.0), ("v2", 0, 5, 0.9, 0.15)]
    assert [x[1:3] for x in cut(frames(spark, [0] * 6), longest=2.0)] == [(0, 2), (2, 4), (4, 5)]
    assert cut(frames(spark, [0])) == [] and cut(frames(spark, [])) == []


def test_segmentation_against_a_plain_loop(spark):
    rng = random.Random(1)
    series = [[rng.random() for _ in range(rng.randint(1, 300))] for _ in range(12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = cut(frames(spark, *series, seconds=0.25), 0.8, 1.5, 4.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k, xs in enumerate(series):
        t, s = np.arange(len(xs), dtype=np.float32) * np.float32(0.25), np.array(xs, np.float32)
        bounds = [0]
        for i in range(1, len(xs)):
            age = t[i] - t[bounds[-1]]
            if (s[i] >= np.float32(0.8) and age >= 1.5) or age >= 4.0:
                bounds.append(i)
        if bounds[-1] != len(xs) - 1:
            bounds.append(len(xs) - 1)
        for a, b in zip(bounds, bounds[1:], strict=False):
            want.append((f"v{k}", a, b, round(float(s[a : b + 1].max()), 4), round(float(s[a : b + 1].astype(float).mean()), 4)))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("threshold", [0.58, 0.32])
def test_thresholds_are_compared_in_double(spark, threshold):
    # float32(0.58) and float32(0.32) lie just below and above the settings.
    score = float(np.float32(threshold))
    got = cut(frames(spark, [0, 0, 0, score, 0, 0]), threshold)
    assert [x[1:3] for x in got] == ([(0, 3), (3, 5)] if score >= threshold else [(0, 5)])


def test_pooling_shares_the_boundary_frame(spark):
    vectors = spark.createDataFrame([("v0", i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])], "video_key string, frame_ordinal int, embedding array<float>")
    cutting = spark.createDataFrame([("v0", "low", 0, 0, 1), ("v0", "low", 1, 1, 2)], "video_key string, level string, segment_no int, start_index int, end_index int")
    got = [r["embedding"] for r in segments.mean_pool(vectors, cutting).orderBy("segment_no").collect()]
    assert np.allclose(got, [[0.5**0.5, 0.5**0.5], [0.0, 1.0]], atol=1e-6)


HIT = "video_key string, question_id string, level string, segment_id string, segment_no int, start_index int, end_index int, start_time_sec double, end_time_sec double, duration_sec double"


def seg(no, a, b, v, level="low"):
    return ("v", level, f"{level}_{no}", no, a, b, float(a), float(b), float(b - a), v)


SEG = HIT.replace("question_id string, ", "") + ", embedding array<float>"


def test_top_segments_ties_and_nan(spark):
    rows = [seg(0, 0, 1, [0.0, 1.0]), seg(1, 1, 2, [1.0, 0.0]), seg(2, 2, 3, [1.0, 0.0]), seg(3, 3, 4, [float("nan"), 0.0])]
    asked = spark.createDataFrame([("v", "q", [1.0, 0.0])], "video_key string, question_id string, query array<float>")
    got = retrieve.top_segments(spark.createDataFrame(rows, SEG), asked, 4).orderBy("rank").collect()
    assert [r["segment_no"] for r in got] == [1, 2, 0, 3]


def test_containment(spark):
    high = spark.createDataFrame([seg(0, 0, 10, [1.0], "high"), seg(1, 20, 30, [1.0], "high"), seg(2, 0, 12, [1.0], "high")], SEG).withColumn("question_id", F.lit("q"))
    low = spark.createDataFrame([seg(i, a, b, [1.0]) for i, (a, b) in enumerate([(0, 4), (4, 10), (8, 13), (20, 30), (10, 20)])], SEG)
    asked = spark.createDataFrame([("v", "q", [1.0])], "video_key string, question_id string, query array<float>")
    got = retrieve.low_candidates(high, low, asked, 9).orderBy("segment_no").collect()
    assert [r["segment_no"] for r in got] == [0, 1, 3]


def test_evidence(spark):
    hits = spark.createDataFrame([("v", "q", 0, 10), ("v", "q", 10, 20)], "video_key string, question_id string, start_index int, end_index int")
    all_frames = spark.createDataFrame([("v", i, i / 4) for i in range(30)], "video_key string, frame_ordinal int, time_sec float")
    got = retrieve.evidence_frames(hits, all_frames, 8).orderBy("position").collect()
    assert [r["frame_index"] for r in got] == [0, 3, 7, 10, 13, 17, 20]
    few = retrieve.evidence_frames(hits, all_frames, 1).collect()
    assert [r["frame_index"] for r in few] == [0]
    assert retrieve.evidence_frames(hits.limit(0), all_frames, 8).count() == 0


def test_baseline_matches_what_retrieval_showed(spark):
    asked = spark.createDataFrame([("v", "a"), ("v", "b"), ("v", "c")], "video_key string, question_id string")
    known = spark.createDataFrame([("v", "a", 2), ("v", "b", 0)], "video_key string, question_id string, n_frames int")
    got = baseline_frames(asked, spark.createDataFrame([("v", i) for i in range(9)], "video_key string, frame_ordinal int"), 4, known)
    rows = {}
    for r in got.orderBy("question_id", "position").collect():
        rows.setdefault((r["question_id"], r["frame_budget"]), []).append(r["frame_index"])
    assert rows == {("a", 2): [0, 8], ("b", 1): [0], ("c", 4): [0, 3, 5, 8]}


def test_frame_budget(spark):
    asked = spark.createDataFrame([("v", "a"), ("v", "b"), ("v", "c")], "video_key string, question_id string")
    known = spark.createDataFrame([("v", "a", 5), ("v", "b", 0)], "video_key string, question_id string, n_frames int")
    got = retrieve.frame_budget(asked, known, 64).orderBy("question_id").collect()
    assert [r["frame_budget"] for r in got] == [5, 1, 64]


def test_whole_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for v in ("a", "b"):
        for i in range(80):
            x, y = (z / np.linalg.norm(z) for z in (rng.normal(size=8), rng.normal(size=8)))
            rows.append((v, i, i / 4, float(rng.random()), [float(t) for t in x], [float(t) for t in y]))
    video = spark.createDataFrame(rows, "video_key string, frame_ordinal int, time_sec float, energy float, embedding array<float>, dino_embedding array<float>")
    index = build_index(video, IndexConfig(high_min_seconds=4.0))
    index.write(str(tmp_path))
    index = VideoIndex.read(spark, str(tmp_path))
    asked = spark.createDataFrame(
        [("a", "1", "What?", ["A. x", "B. y"], "A", [1.0] + [0.0] * 7), ("c", "2", "Why?", ["A. x"], "B", [1.0] + [0.0] * 7)],
        "video_key string, question_id string, question string, options array<string>, answer string, query array<float>",
    )
    found = run_retrieval(index, asked, RetrievalConfig(max_evidence_frames=5))
    rows = {r["question_id"]: r for r in evaluate(asked, found, StubAnswerer).collect()}
    assert len(rows) == 2 and 0 < len(rows["1"]["evidence_frames"]) <= 5
    assert rows["2"]["evidence_frames"] == [] and rows["2"]["predicted_letter"] in "ABCD"
    base = {r["question_id"]: r for r in evaluate_baseline(asked.drop("query"), video, StubAnswerer, 6).collect()}
    assert [f["frame_index"] for f in base["1"]["frames"]] == [0, 16, 32, 47, 63, 79]


def test_pooling_scans_once(spark):
    scored = frames(spark, [0, 0.9, 0.1, 0.9, 0.9, 0.2])
    found = segments.segment_levels(scored, {"low": (0.5, 1.0), "high": (0.8, 3.0)}, score="s")
    pooled = segments.mean_pool(scored.withColumn("embedding", F.array("s", F.lit(1.0))), found)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert set(pooled.columns) == {*found.columns, "embedding"} and pooled.count() == found.count()


def test_energy(spark):
    grey = bytes([10, 10, 10] * 4), bytes([20, 20, 20] * 4), bytes([20, 20, 20] * 4)
    rows = [(v, i, {"height": 2, "width": 2, "nChannels": 3, "data": bytearray(b)}) for v in ("a", "b") for i, b in enumerate(grey)]
    df = spark.createDataFrame(rows, "video_key string, frame_ordinal int, image struct<height:int,width:int,nChannels:int,data:binary>")
    whole = signals.frame_energy(df)
    assert whole.columns == [*df.columns, "energy"] and "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    got = whole.orderBy("video_key", "frame_ordinal").collect()
    assert [round(r["energy"], 5) for r in got] == [0.0, round(10 / 255, 5), 0.0] * 2


def test_top_k_must_be_positive():
    with pytest.raises(ValueError, match="at least 1"):
        RetrievalConfig(top_high=0)
