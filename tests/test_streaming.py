from chronoreel.streaming.segments import scaled, segment_stream


def test_stream_closes_segments_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "video_key string, frame_ordinal int, time_sec double, x double"
    values = [0, 9, 1, 9, 9, 2, 0, 9]
    query = None
    for part in (slice(0, 3), slice(3, 8)):
        rows = [("v", i, float(i), float(values[i])) for i in range(8)[part]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        if query is None:
            stream = scaled(spark.readStream.schema(schema).parquet(str(source)), "x", 0, 10)
            query = segment_stream(stream, 0.5, 2.0).writeStream.format("memory").queryName("cuts").option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
    query.stop()
    got = sorted((r["start_index"], r["end_index"], round(r["mean_score"], 3)) for r in spark.table("cuts").collect())
    assert got == [(0, 3, 0.475), (3, 7, 0.58)]


def test_idle_videos_are_closed(spark, tmp_path):
    import time

    source = tmp_path / "in"
    schema = "video_key string, frame_ordinal int, time_sec double, x double"

    def more(video, values):
        rows = [(video, i, float(i), float(x)) for i, x in enumerate(values)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    more("v", [0, 9, 1, 9, 1])
    stream = scaled(spark.readStream.schema(schema).parquet(str(source)), "x", 0, 10)
    query = segment_stream(stream, 0.5, 2.0, idle_ms=200).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).start()
    deadline = time.time() + 60
    while time.time() < deadline and not any(r["video_key"] == "v" and r["end_index"] == 4 for r in spark.table("idle").collect()):
        time.sleep(1)
        more("w", [0])
    query.stop()
    got = sorted((r["start_index"], r["end_index"]) for r in spark.table("idle").where("video_key = 'v'").collect())
    assert got == [(0, 3), (3, 4)]


def _events(n=300, videos=3, seed=5):
    import datetime
    import random

    rng = random.Random(seed)
    base = datetime.datetime(2024, 1, 1)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0.0, 0.5, 30.0, 400.0])
        rows.append((f"v{rng.randrange(videos)}", base + datetime.timedelta(seconds=at), i, float(rng.random())))
    return rows


EVENT = "video_key string, ts timestamp, tie long, score double"


def _streamed(spark, folder, files, **options):
    """Closed segments of a stream that gets one file in each micro-batch, and at last an event far later."""
    import datetime
    import os

    from chronoreel.streaming.ordered import segment_events

    files = [*files, [("later", datetime.datetime(2030, 1, 1), 0, 0.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
        for name in os.listdir(f"{folder}/part{i}"):
            os.utime(f"{folder}/part{i}/{name}", (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")
    out = segment_events(stream, 0.6, 100.0, **options)
    query = out.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return {tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in spark.read.parquet(f"{folder}-out").collect()}


def _batch(spark, rows, **options):
    from pyspark.sql import functions as F

    from chronoreel.operators.segments import segment_by_threshold
    from chronoreel.streaming.ordered import NAMES

    df = spark.createDataFrame(rows, EVENT).withColumn("frame_ordinal", F.expr("cast(row_number() OVER (PARTITION BY video_key ORDER BY ts, tie) - 1 AS int)"))
    df = df.withColumn("time_sec", (F.expr("unix_micros(ts) - min(unix_micros(ts)) OVER (PARTITION BY video_key)") / 1e6).cast("float"))
    found = segment_by_threshold(df, 0.6, 100.0, "low", score="score", **options)
    return {tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in found.select(*NAMES).collect()}


def test_late_frames_are_put_in_order(spark, tmp_path):
    import datetime
    import random

    rows = _events()
    rng = random.Random(1)
    # Up to 50 minutes late: every file has frames that lie before some of the files before.
    arrival = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=3000 * rng.random()))
    assert arrival != sorted(rows, key=lambda r: (r[1], r[2]))
    files = [arrival[i : i + 75] for i in range(0, 300, 75)]
    got = _streamed(spark, str(tmp_path / "a"), files, delay="50 minutes", idle_seconds=7200.0, max_seconds=2000.0)
    assert got == _batch(spark, rows, max_seconds=2000.0) and len(got) > 20


def test_stream_goes_on_where_a_batch_ends(spark, tmp_path):
    from chronoreel.streaming.ordered import open_segments

    rows = sorted(_events(200, 2, 9), key=lambda r: (r[1], r[2]))
    old, new = spark.createDataFrame(rows[:120], EVENT), rows[120:]
    start = open_segments(old, 0.6, 100.0)
    got = _streamed(spark, str(tmp_path / "b"), [new[:40], new[40:]], delay="1 second", idle_seconds=100_000.0, initial=start)
    whole, before = _batch(spark, rows), _batch(spark, rows[:120])
    closed = {r for r in before if r in whole}
    assert got == whole - closed and 0 < len(closed) < len(whole)


def test_idle_video_is_closed_and_begins_again(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    first = [("v", at(i * 60), i, 0.9 if i in (2, 4) else 0.1) for i in range(6)]
    other = [("w", at(90_000), 0, 0.0)]
    again = [("v", at(100_000 + i), i, 0.1) for i in range(3)]
    got = _streamed(spark, str(tmp_path / "c"), [first, other, again], delay="0 seconds", idle_seconds=3600.0)
    assert sorted(r[:4] for r in got) == [("v", 0, 0, 2), ("v", 0, 0, 2), ("v", 1, 2, 4), ("v", 2, 4, 5)]
    assert got == _streamed(spark, str(tmp_path / "d"), [[*first, *other, *again]], delay="0 seconds", idle_seconds=3600.0)


def test_a_video_in_a_batch_takes_few_calls_to_the_state_store():
    import pandas as pd

    from chronoreel.streaming.ordered import OrderedSegments

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    processor = OrderedSegments(0.5, 1.0, None, 1000.0)
    processor.init(Handle())
    frames = lambda *xs: iter([pd.DataFrame({"at": [x * 1_000_000 for x in xs], "tie": list(xs), "score": [0.9] * len(xs)})])
    out = [list(processor.handleInputRows(("v",), frames(3, 1), Times(0))), list(processor.handleInputRows(("v",), frames(2, 9), Times(3000)))]
    assert calls == ["get", "update", "register", "get", "update", "delete", "register"]
    assert out[0] == [] and [(r.start_index, r.end_index) for r in out[1][0].itertuples()] == [(0, 1), (1, 2)]
    rest = list(processor.handleExpiredTimer(("v",), Times(2_000_000), None))
    assert [(r.start_index, r.end_index) for r in rest[0].itertuples()] == [(2, 3)] and calls[7:] == ["get", "clear", "delete"]
