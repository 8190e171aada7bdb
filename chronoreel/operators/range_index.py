"""Sums, means and maxima over any ranges of a video's frames, from an index that is built once.

Frames are cut into blocks of consecutive ordinals. The index has running sums of the vectors inside each block, the sums
of all blocks before, and for the scores each block's values and the maxima of 1, 2, 4, ... blocks from there on. A range is
then answered from its two ends: a sum is the difference of two running sums, a maximum that of two parts of blocks and two
overlapping runs of whole ones. So a list of segments meets two frames and four blocks each, whatever its frames, and all levels and lists use
one index. A long video is many blocks, dealt to many tasks.

Ordinals of a video have no gaps; a video that has some is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.vectors import l2_normalize
from chronoreel.plans.store import written_once

BLOCK = 256
KEY = ["video_key", "level", "segment_no"]


@dataclass(frozen=True)
class RangeIndex:
    """sums: video_key, frame_ordinal, block, upto (the block's vectors to this frame), own. bases: video_key, block, base. blocks: video_key, block, values, maxima, total_before."""

    sums: DataFrame
    bases: DataFrame
    blocks: DataFrame
    block_rows: int


def _dense(frames: DataFrame) -> None:
    sizes = frames.groupBy("video_key").agg((F.max("frame_ordinal") - F.min("frame_ordinal") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
    for r in sizes.where(F.col("span") != F.col("n")).limit(1).collect():
        raise ValueError(f"the ordinals of {r['video_key']!r} have gaps or repeats")


def build(frames: DataFrame, column: str = "embedding", score: str = "score", block_rows: int = BLOCK) -> RangeIndex:
    """The index of frames with a vector ``column`` and a ``score``."""
    _dense(frames)
    block = F.floor(F.col("frame_ordinal") / block_rows).cast("int").alias("block")
    rows = frames.select("video_key", "frame_ordinal", block, F.col(column).cast("array<double>").alias("own"))

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, so_far = None, None
        for pdf in batches:
            out = []
            for video, at, v in zip(pdf["video_key"], pdf["block"], pdf["own"], strict=True):
                so_far = v + so_far if (video, at) == key else v
                key = (video, at)
                out.append(so_far)
            yield pdf.assign(upto=pd.Series(out, index=pdf.index, dtype=object))

    dealt = rows.repartition("video_key", "block").sortWithinPartitions("video_key", "block", "frame_ordinal")
    kind = frames.schema["frame_ordinal"].dataType.simpleString()
    sums = written_once(dealt.mapInPandas(running, f"video_key string, frame_ordinal {kind}, block int, own array<double>, upto array<double>"))

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, so_far = None, None
        for pdf in batches:
            out = []
            for video, v in zip(pdf["video_key"], pdf["total"], strict=True):
                so_far = so_far if video == key and so_far is not None else np.zeros(len(v))
                key = video
                out.append(so_far)
                so_far = so_far + v
            yield pdf[["video_key", "block"]].assign(base=pd.Series(out, index=pdf.index, dtype=object))

    totals = sums.groupBy("video_key", "block").agg(F.max_by("upto", "frame_ordinal").alias("total"))
    bases = totals.repartition("video_key").sortWithinPartitions("video_key", "block").mapInPandas(before, "video_key string, block int, base array<double>")
    return RangeIndex(sums, written_once(bases), written_once(_maxima(frames, score, block_rows)), block_rows)


def _maxima(frames: DataFrame, score: str, block_rows: int) -> DataFrame:
    """(video_key, block, first, values, maxima, total_before): the k-th of maxima is that of 2^k blocks from here on, as far as there are so many."""
    block = F.floor(F.col("frame_ordinal") / block_rows).cast("int").alias("block")
    at = F.struct("frame_ordinal", F.col(score).cast("double").alias("s"))
    rows = frames.select("video_key", block, at.alias("x")).groupBy("video_key", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = rows.select("video_key", "block", F.col("x")[0]["frame_ordinal"].alias("first"), F.transform("x", lambda x: x["s"]).alias("values"))
    rows = written_once(rows.withColumn("m0", F.array_max("values")).withColumn("sum", F.aggregate("values", F.lit(0.0), lambda a, x: a + x)))
    many = rows.groupBy("video_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    w = Window.partitionBy("video_key").orderBy("block")
    names = ["m0"]
    while 2 ** len(names) <= many:
        last, step = names[-1], 2 ** (len(names) - 1)
        rows = rows.withColumn(f"m{len(names)}", F.greatest(F.col(last), F.lead(last, step).over(w)))
        names.append(f"m{len(names)}")
    total = F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select("video_key", "block", "first", "values", F.array(*names).alias("maxima"), total.alias("total_before"))


def pool(index: RangeIndex, segments: DataFrame) -> DataFrame:
    """``segments`` with embedding: the mean of their frames' vectors, both ends included, scaled to length one."""
    n = F.col("end_index") - F.col("start_index") + 1
    ends = segments.select(*KEY, n.alias("n"), F.explode(F.array(F.struct(F.col("start_index").alias("frame_ordinal"), F.lit(False).alias("upper")), F.struct(F.col("end_index").alias("frame_ordinal"), F.lit(True).alias("upper")))).alias("e"))
    ends = ends.select(*KEY, "n", "e.*").join(index.sums, ["video_key", "frame_ordinal"]).join(index.bases, ["video_key", "block"])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    take = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    upto = F.when(F.col("upper"), add(F.col("base"), F.col("upto"))).otherwise(take(add(F.col("base"), F.col("upto")), F.col("own")))
    both = ends.select(*KEY, "n", "upper", upto.alias("v")).groupBy(*KEY).agg(F.first("n").alias("n"), F.max_by("v", "upper").alias("high"), F.min_by("v", "upper").alias("low"))
    mean = F.transform(take(F.col("high"), F.col("low")), lambda x: x / F.col("n"))
    pooled = both.select(*KEY, l2_normalize(mean).cast("array<float>").alias("embedding"))
    return segments.join(pooled, KEY)


def peaks(index: RangeIndex, segments: DataFrame) -> DataFrame:
    """(video_key, level, segment_no, peak_score, mean_score) of each segment's frames, both ends included."""
    size = index.block_rows
    a, b = (F.floor(F.col(c) / size).cast("int") for c in ("start_index", "end_index"))
    whole = F.col("b") - F.col("a") - 1
    k = F.floor(F.log2(F.greatest(whole, F.lit(1)))).cast("int")
    part = lambda block, low, high, k=None: F.struct(block.alias("block"), low.cast("int").alias("low"), high.cast("int").alias("high"), (F.lit(None) if k is None else k).cast("int").alias("k"))
    start, end, none = F.col("start_index"), F.col("end_index"), F.lit(None)
    one = F.array(part(F.col("a"), start, end))
    two = F.array(part(F.col("a"), start, (F.col("a") + 1) * size - 1), part(F.col("b"), F.col("b") * size, end))
    more = F.array(part(F.col("a") + 1, none, none, k), part((F.col("b") - F.pow(F.lit(2), k)).cast("int"), none, none, k))
    asked = F.when(F.col("a") == F.col("b"), one).when(whole == 0, two).otherwise(F.concat(two, more))
    parts = segments.select(*KEY, "start_index", "end_index", a.alias("a"), b.alias("b")).withColumn("p", F.explode(asked))
    met = parts.select(*KEY, (end - start + 1).alias("n"), "p.*", (F.col("p.low") == start).alias("from_start"), (F.col("p.high") == end).alias("to_end")).join(index.blocks, ["video_key", "block"])
    inside = F.slice("values", F.col("low") - F.col("first") + 1, F.col("high") - F.col("low") + 1)
    peak = F.when(F.col("k").isNull(), F.array_max(inside)).otherwise(F.get("maxima", F.col("k")))
    run = lambda until: F.col("total_before") + F.aggregate(F.slice("values", F.lit(1), until - F.col("first")), F.lit(0.0), lambda s, x: s + x)
    signed = F.when(F.col("to_end"), run(F.col("high") + 1)).otherwise(F.lit(0.0)) - F.when(F.col("from_start"), run(F.col("low"))).otherwise(F.lit(0.0))
    found = met.select(*KEY, "n", peak.alias("peak"), F.coalesce(F.when(F.col("k").isNull(), signed), F.lit(0.0)).alias("sum"))
    return found.groupBy(*KEY).agg(F.max("peak").alias("peak_score"), (F.sum("sum") / F.first("n")).alias("mean_score"))
