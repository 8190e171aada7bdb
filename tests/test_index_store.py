"""The index on disk, the bounded search, the decimated plot, the table function."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoreel.config import RetrievalConfig
from chronoreel.operators import retrieve, segments, signals, topk, udtf
from chronoreel.plans.index_store import IndexStore
from chronoreel.plans.pipeline import VideoIndex
from chronoreel.plans.pipeline import retrieve as plain_retrieve
from chronoreel.sources import sinks


def videos(spark, names, n=60, width=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for v in names:
        x = rng.normal(size=(n, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(v, i, i / 4, [float(t) for t in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "video_key string, frame_ordinal int, time_sec float, embedding array<float>")


def build(frames):
    scored = signals.cosine_drift(frames).withColumn("score", signals.minmax("drift"))
    found = segments.mean_pool(frames, segments.segment_levels(scored, {"low": (0.3, 1.0), "high": (0.5, 4.0)}, score="score"))
    return VideoIndex(scored.drop("embedding"), found.where("level = 'high'"), found.where("level = 'low'"))


def table(df):
    return sorted(str([round(x, 4) if isinstance(x, float) else x for x in r.asDict().values()]) for r in df.select(*sorted(c for c in df.columns if c not in ("embedding", "shard"))).collect())


def test_index_grows_and_answers_as_a_whole_one(spark, tmp_path):
    frames = videos(spark, [f"v{i}" for i in range(12)])
    store = IndexStore(spark, str(tmp_path / "index"), shards=8)
    with pytest.raises(FileNotFoundError, match="no index yet"):
        store.index()
    assert store.grow(frames.where("video_key < 'v4'"), build) == 6
    assert store.grow(frames, build) == 6 and store.grow(frames, build) == 0
    assert len(store.generations()) == 2
    asked = frames.where("frame_ordinal % 30 = 7 AND video_key IN ('v1', 'v11', 'v5')").select("video_key", F.concat("video_key", F.col("frame_ordinal").cast("string")).alias("question_id"), F.col("embedding").alias("query"))
    config = RetrievalConfig(2, 3, 6)
    want = plain_retrieve(build(frames), asked, config)

    def check():
        found = IndexStore(spark, str(tmp_path / "index")).retrieve(asked, config)
        assert all(table(found[k]) == table(want[k]) for k in want) and len(table(want["evidence"])) > 10

    check()
    store.compact()
    assert len(store.generations()) == 1 and store.shards == IndexStore(spark, str(tmp_path / "index"), shards=99).shards == 8
    check()
    assert len(store.vacuum()) == 2 and store.vacuum() == []
    check()


def test_a_stopped_build_leaves_the_index(spark, tmp_path):
    frames = videos(spark, ["a", "b", "c"])
    store = IndexStore(spark, str(tmp_path), shards=4)
    store.grow(frames.where("video_key = 'a'"), build)
    before = table(store.table("low"))

    def stops(rows):
        made = build(rows)
        # Signals and high segments get written, then a task fails.
        return VideoIndex(made.signals, made.high, made.low.withColumn("mean_score", F.raise_error(F.lit("lost"))))

    with pytest.raises(Exception, match="lost"):
        store.grow(frames, stops)
    assert len(store.generations()) == 1 and table(IndexStore(spark, str(tmp_path)).table("low")) == before
    assert len(store.vacuum()) == 1 and table(store.table("low")) == before
    assert store.grow(frames, build) == 2 and store.table("videos").count() == 3


def test_index_side_is_pruned_and_not_shuffled(spark, tmp_path):
    frames = videos(spark, [f"v{i}" for i in range(20)])
    store = IndexStore(spark, str(tmp_path), shards=16)
    store.grow(frames, build)
    asked = spark.createDataFrame([("v3", "q", [1.0, 0.0, 0.0, 0.0])], "video_key string, question_id string, query array<float>").withColumn("shard", store.shard())
    asked.write.parquet(f"{tmp_path}/_asked")
    asked = F.broadcast(spark.read.parquet(f"{tmp_path}/_asked").where("question_id = 'q'"))
    df = retrieve._scored(store.table("low"), asked)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert df.count() > 0
    asked_all = store.retrieve(spark.read.parquet(f"{tmp_path}/_asked"), RetrievalConfig(2, 3, 4))
    assert 0 < asked_all["evidence"].count() <= 4


def segments_of(rng, n, clusters, width=6, nan=False):
    rows, centre = [], None
    for i in range(n):
        if i % max(1, n // clusters) == 0:
            centre = rng.normal(size=width)
        v = centre + 0.05 * rng.normal(size=width)
        v = [float(x) for x in v / np.linalg.norm(v)]
        if nan and i % 17 == 3:
            v[0] = float("nan")
        rows.append(("v", "low", f"low_{i:04d}", i, i, i + 1, float(i), float(i + 1), 1.0, v))
    return rows


SEG = "video_key string, level string, segment_id string, segment_no int, start_index int, end_index int, start_time_sec double, end_time_sec double, duration_sec double, embedding array<float>"


@pytest.mark.parametrize("n,clusters,k,nan", [(640, 20, 3, False), (40, 40, 5, False), (100, 3, 4, True), (5, 1, 9, False), (64, 64, 64, True)])
def test_bounded_search_equals_the_full_scan(spark, n, clusters, k, nan):
    rng = np.random.default_rng(n)
    rows = segments_of(rng, n, clusters, nan=nan)
    rows += [(*rows[0][:2], f"low_{n:04d}", n, *rows[0][4:])]  # a tie
    df = spark.createDataFrame(rows, SEG)
    asked = spark.createDataFrame([("v", f"q{i}", [float(x) for x in rows[i * 7 % n][-1]]) for i in range(4)] + [("v", "zero", [0.0] * 6), ("w", "none", [1.0] * 6)], "video_key string, question_id string, query array<float>")
    found, count = topk.top_segments(topk.blocks(df, 16), asked, k)
    names = ["question_id", "segment_no", "rank", "score"]
    assert table(found.select(*names)) == table(retrieve.top_segments(df, asked, k).select(*names))
    figures = count.first()
    assert figures["all_products"] == 5 * (n + 1) and figures["products"] <= figures["all_products"]
    if clusters == 20:
        # Four of five questions look at a fifth of the segments or less; the zero vector ties with all.
        assert figures["products"] < 0.45 * figures["all_products"]


def test_plot_takes_a_bounded_number_of_rows(spark):
    rng = random.Random(2)
    rows = [(v, i, i / 4, rng.random(), rng.random() if i else None, float("nan") if i % 2 else 0.5, 1.0) for v, n in (("a", 5000), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "video_key string, frame_ordinal int, time_sec float, energy double, openclip double, dino double, combined double")
    found = sinks.decimated(df, 40).toPandas()
    assert found.groupby(["video_key", "signal"]).size().max() <= 80
    one = found[(found.video_key == "a") & (found.signal == "energy")]
    values = np.array([r[3] for r in rows if r[0] == "a"])
    pixel = np.minimum((np.arange(5000) / 4999 * 40).astype(int), 39)
    for p in range(40):
        assert set(one[one.pixel == p].value) == {values[pixel == p].min(), values[pixel == p].max()}
    assert len(found[(found.video_key == "b") & (found.signal == "energy")]) == 3 and len(found[(found.video_key == "c") & (found.signal == "openclip")]) == 0
    panels = sinks.signal_panels(df, "a", 40)
    assert [p[0] for p in panels] == list(sinks.SIGNALS) and all(len(t) == len(v) <= 80 and t == sorted(t) for _, t, v in panels)
    with pytest.raises(ValueError, match="width"):
        sinks.decimated(df, 0)


def test_table_function(spark):
    udtf.register(spark)
    rows = [(v, i, float(i), random.Random(f"{v}{i}").random()) for v, n in (("a", 3000), ("b", 1), ("c", 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "video_key string, frame_ordinal int, time_sec float, score double").repartition(5)
    got = spark.sql("SELECT * FROM segment_frames(TABLE(SELECT * FROM {df}) PARTITION BY video_key ORDER BY (frame_ordinal), 0.7D, 3D, 20D)", df=df)
    want = segments.segment_by_threshold(df, 0.7, 3.0, "low", 20.0, "score").select(*got.columns)
    assert table(got) == table(want) and got.count() > 100
