"""Videos that one task cannot go through: halo exchange, segmentation over ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoreel.operators import halo, segment_ranges, segments, signals

IMAGE = "video_key string, frame_ordinal int, image struct<height:int,width:int,nChannels:int,data:binary>"


def images(spark, rng, *lengths):
    rows = [(f"v{k}", i, {"height": 2, "width": 3, "nChannels": 3, "data": bytearray(rng.randbytes(18))}) for k, n in enumerate(lengths) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, IMAGE)


def by_frame(df, column):
    return {(r["video_key"], r["frame_ordinal"]): round(r[column], 6) for r in df.collect()}


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_energy_of_one_video_over_many_tasks(spark, ranges):
    df = images(spark, random.Random(ranges), 90, 1, 2, 30)
    want = by_frame(signals.frame_energy(df), "energy")
    dealt = df.repartitionByRange(ranges, "video_key", "frame_ordinal")
    found = halo.runs(dealt, "image", halo.ENERGY)
    assert by_frame(halo.frame_energy(dealt), "energy") == want and len(want) == 123
    assert (found.where("video_key = 'v0'").select("part").distinct().count() > 1) == (ranges > 1)
    # Two edges a task and video at most, and nothing is shuffled on the way there.
    assert found.where("edge IS NOT NULL").count() <= 2 * (ranges + 4)
    stored = df.coalesce(1)
    plan = halo.runs(stored, "image", halo.ENERGY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_frames_that_lie_between_each_other_are_dealt_anew(spark):
    df = images(spark, random.Random(4), 60, 7).repartition(5)
    assert not halo.in_order(halo.runs(df, "image", halo.ENERGY))
    assert by_frame(halo.frame_energy(df), "energy") == by_frame(signals.frame_energy(df), "energy")
    assert halo.frame_energy(df.limit(0)).count() == 0


def test_drift_over_ranges(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(70, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("a" if i < 60 else "b", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "video_key string, frame_ordinal int, embedding array<float>")
    assert by_frame(halo.cosine_drift(df.repartitionByRange(6, "video_key", "frame_ordinal")), "drift") == by_frame(signals.cosine_drift(df), "drift")


NAMES = ["video_key", "level", "segment_no", "segment_id", "start_index", "end_index", "start_time_sec", "end_time_sec", "duration_sec", "peak_score", "mean_score"]


def rows_of(df):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("ranges,longest,seed", [(8, None, 1), (8, 3.0, 2), (1, 4.0, 3), (13, None, 4), (30, 0.5, 5)])
def test_segments_over_ranges_equal_the_scan(spark, ranges, longest, seed):
    rng = random.Random(seed)
    rows = []
    for k, n in enumerate([600, 1, 2, 40, 3, 0, 90]):
        t = np.cumsum([rng.choice([0.0, 0.25, 0.25, 1.0]) for _ in range(n)])
        hot = rng.choice([0.02, 0.2, 0.6])
        rows += [(f"v{k}", i, float(t[i]), rng.random() if rng.random() < hot else 0.3 * rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "video_key string, frame_ordinal int, time_sec float, s float").repartition(3)
    levels = {"low": (0.32, 1.0), "high": (0.58, 6.0), "never": (2.0, 1.0)}
    want = rows_of(segments.segment_levels(df, levels, longest, "s"))
    assert rows_of(segment_ranges.segment_levels(df, levels, longest, "s", ranges)) == want
    assert len(want) > 5


def test_a_video_is_spread_and_its_summary_is_short(spark):
    df = spark.range(5000).select(F.lit("one").alias("video_key"), F.col("id").cast("int").alias("frame_ordinal"), (F.col("id") / 4).cast("float").alias("time_sec"), F.rand(7).cast("float").alias("s"))
    rows = segment_ranges.in_ranges(df, "s", 8)
    assert rows.select("part").distinct().count() == 8
    pdf = rows.where("part = 3").orderBy("frame_ordinal").toPandas()
    found = segment_ranges.summary(pdf["frame_ordinal"].to_numpy(), pdf["t"].to_numpy(np.float32), pdf["s"].to_numpy() >= 0.6, 2.0, np.inf)
    assert 1 <= len(found) < len(pdf) / 10
    assert rows_of(segment_ranges.segment_levels(df, {"low": (0.6, 2.0)}, None, "s", 8)) == rows_of(segments.segment_levels(df, {"low": (0.6, 2.0)}, None, "s"))
    assert segment_ranges.segment_levels(df.limit(0), {"low": (0.6, 2.0)}, None, "s").count() == 0


def test_first_old_enough_rounds_as_the_scan_does():
    rng = np.random.default_rng(2)
    t = np.sort((rng.random(400) * 1e5).astype(np.float32))
    for least in (0.0, 0.32, 100.1, 5e4, 1e9):
        got = segment_ranges._first_old_enough(t, t, least)
        want = [next((k for k in range(len(t)) if np.float64(t[k] - x) >= least), len(t)) for x in t]
        assert got.tolist() == want


def test_a_range_is_held_in_arrays_and_frames_carry_no_lists(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    n, rows = 400_000, 10_000
    numbers = np.arange(n)
    columns = [pa.array(["a video with a long name"] * n), pa.array(np.zeros(n, np.int32)), pa.array(numbers.astype(np.int32)), pa.array((numbers / 4).astype(np.float32)), pa.array(np.ones(n, np.float32))]
    batches = pa.RecordBatch.from_arrays([*columns, pa.array([7] * n, pa.int32())], ["video_key", "part", "frame_ordinal", "t", "s", "entry_index_0"])
    tracemalloc.start()
    (key, part, ordinal, t, s, more) = next(iter(segment_ranges._by_video(batches.slice(i, rows) for i in range(0, n, rows))))
    assert tracemalloc.get_traced_memory()[1] < 48 * n
    tracemalloc.stop()
    assert (key, part, more, len(t)) == ("a video with a long name", 0, [7], n) and (ordinal == numbers).all() and s.all()
    seen = []
    plan = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *x: seen.append(df.schema.simpleString()) or plan(df, *x))
    df = spark.range(50).select(F.lit("v").alias("video_key"), F.col("id").cast("int").alias("frame_ordinal"), F.col("id").cast("float").alias("time_sec"), F.rand(1).cast("float").alias("s"))
    assert segment_ranges.segment_levels(df, {"low": (0.5, 2.0), "high": (0.8, 3.0)}, None, "s", 4).count() > 0
    assert len(seen) == 2 and not any("array" in x for x in seen)


def test_a_range_does_not_grow_with_the_frames(spark, monkeypatch):
    monkeypatch.setattr(segment_ranges, "RANGE_FRAMES", 500)
    df = spark.range(6000).select(F.lit("one").alias("video_key"), F.col("id").cast("int").alias("frame_ordinal"), (F.col("id") / 4).cast("float").alias("time_sec"), F.rand(7).cast("float").alias("s")).cache()
    largest = segment_ranges.in_ranges(df, "s", 2).groupBy("part").count().agg(F.max("count")).first()[0]
    assert largest <= 1000
    levels = {"low": (0.5, 2.0), "high": (0.9, 6.0)}
    assert rows_of(segment_ranges.segment_levels(df, levels, None, "s", 2)) == rows_of(segments.segment_levels(df, levels, None, "s"))
