"""Figures of ranges from an index equal those taken frame by frame."""

import random

import numpy as np
import pytest

from chronoreel.operators import range_index, segments

FRAME = "video_key string, frame_ordinal int, embedding array<float>, score float"
SEGMENT = "video_key string, level string, segment_no int, start_index int, end_index int"


@pytest.mark.parametrize("size,first", [(1, 0), (4, 0), (16, 3), (500, 0)])
def test_any_range_equals_its_frames(spark, size, first):
    rng = random.Random(size)
    lengths = {"a": 150, "b": 1, "c": 37}
    data = {v: [(i + first, [rng.gauss(0, 1) for _ in range(3)], rng.uniform(-5, 5)) for i in range(n)] for v, n in lengths.items()}
    frames = spark.createDataFrame([(v, *x) for v, xs in data.items() for x in xs], FRAME).repartition(4)
    cuts = []
    for v, n in lengths.items():
        some = [(0, n - 1), (0, 0), (n - 1, n - 1)] + [sorted((rng.randrange(n), rng.randrange(n))) for _ in range(25)]
        cuts += [(v, "low" if k % 2 else "high", k, a + first, b + first) for k, (a, b) in enumerate(some)]
    cut = spark.createDataFrame(cuts, SEGMENT)
    index = range_index.build(frames, block_rows=size)
    got = {(r["video_key"], r["segment_no"]): r for r in range_index.peaks(index, cut).collect()}
    pooled = {(r["video_key"], r["segment_no"]): r["embedding"] for r in range_index.pool(index, cut).collect()}
    assert len(got) == len(pooled) == len(cuts)
    for v, _, no, a, b in cuts:
        inside = [x for x in data[v] if a <= x[0] <= b]
        scores = np.array([x[2] for x in inside], np.float32).astype(float)
        assert got[v, no]["peak_score"] == scores.max() and got[v, no]["mean_score"] == pytest.approx(scores.mean())
        mean = np.array([x[1] for x in inside], np.float32).astype(float).mean(axis=0)
        assert np.allclose(pooled[v, no], mean / np.linalg.norm(mean), atol=1e-5)
    plain = {(r["video_key"], r["segment_no"]): r["embedding"] for r in segments.mean_pool(frames, cut).collect()}
    assert all(np.allclose(plain[k], pooled[k], atol=1e-5) for k in plain)


def test_a_segment_meets_two_frames_and_four_blocks(spark):
    frames = spark.range(4000).selectExpr("'v' AS video_key", "cast(id AS int) AS frame_ordinal", "array(cast(id AS float), 1f) AS embedding", "cast(id % 97 AS float) AS score")
    index = range_index.build(frames, block_rows=64)
    cut = spark.createDataFrame([("v", "low", 0, 5, 3990)], SEGMENT)
    assert index.blocks.count() == 63 and len(index.blocks.first()["maxima"]) == 6
    found = range_index.peaks(index, cut).first()
    assert found["peak_score"] == 96.0 and found["mean_score"] == pytest.approx(sum(i % 97 for i in range(5, 3991)) / 3986)
    plan = range_index.peaks(index, cut)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "sequence" not in plan


def test_gaps_are_refused_and_empty_tables_pass(spark):
    frames = spark.createDataFrame([("v", 0, [1.0], 1.0), ("v", 2, [1.0], 1.0)], FRAME)
    with pytest.raises(ValueError, match="gaps or repeats"):
        range_index.build(frames)
    index = range_index.build(frames.limit(0))
    assert range_index.pool(index, spark.createDataFrame([], SEGMENT)).count() == 0
