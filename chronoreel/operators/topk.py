"""Exact nearest segments without a product for each: blocks whose bound lies below the k-th score are left out.

Neighbouring segments of a video are blocks with a centre and a radius, so no segment of a block scores more than
centre . query + radius * |query|. A question takes the blocks with the best bounds first, until they have k segments; the k-th
score among these is what the other blocks' bounds must reach. Blocks are made once for any number of questions.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.vectors import dot
from chronoreel.operators.retrieve import HIT, _best
from chronoreel.plans.store import written_once

BLOCK = 32
OWN = [c for c in HIT if c not in ("video_key", "question_id")]


def blocks(segments: DataFrame, size: int = BLOCK) -> DataFrame:
    """(video_key, level, block, centre, radius, n, members): ``size`` consecutive segments each; a block with a vector that is not finite has an endless radius."""
    block = F.floor(F.col("segment_no") / size).alias("block")
    rows = segments.select("video_key", "level", block, F.struct(*[c for c in OWN if c != "level"], "embedding").alias("m"))
    centres = rows.groupBy("video_key", "level", "block").agg(Summarizer.mean(array_to_vector(F.col("m.embedding"))).alias("c"), F.collect_list("m").alias("members"))
    gap = lambda m: F.sqrt(F.aggregate(F.zip_with(m["embedding"], F.col("centre"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    found = centres.select("video_key", "level", "block", vector_to_array("c").alias("centre"), "members")
    far = F.array_max(F.transform("members", gap))
    radius = F.when(F.isnan(far) | (far == float("inf")), F.lit(float("inf"))).otherwise(far)
    return written_once(found.select("video_key", "level", "block", "centre", radius.alias("radius"), F.size("members").alias("n"), "members"))


def top_segments(made: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k segments of each question's video that are nearest, as ``retrieve.top_segments`` has them, and (products, all_products) as one row."""
    key = ["video_key", "question_id"]
    pairs = made.drop("members").join(questions.select(*key, "query"), "video_key")
    length = F.sqrt(dot(F.col("query"), F.col("query")))
    # Rounding may take a bound a little below a score.
    bound = dot(F.col("centre"), F.col("query")) + F.col("radius") * length * (1 + 1e-9) + 1e-9 * (1 + length)
    pairs = pairs.select(*key, "level", "block", "n", "query", F.when(F.isnan(bound) | bound.isNull(), F.lit(float("inf"))).otherwise(bound).alias("bound"))
    order = Window.partitionBy(*key).orderBy(F.col("bound").desc(), "level", "block").rowsBetween(Window.unboundedPreceding, -1)
    pairs = written_once(pairs.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)) < k))
    members = made.select("video_key", "level", "block", "members")

    def scored(some: DataFrame) -> DataFrame:
        met = some.select(*key, "level", "block", "query").join(members, ["video_key", "level", "block"]).select(*key, "level", "query", F.explode("members").alias("m"))
        return met.select(*key, "level", *[f"m.{c}" for c in OWN if c != "level"], dot(F.col("m.embedding"), F.col("query")).alias("score")).select(*HIT, "score")

    near = written_once(_best(scored(pairs.where("first")), k))
    # With fewer than k finite scores every block has to be looked at.
    least = near.where(~F.isnan("score")).groupBy(*key).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    least = least.where(F.col("found") >= k).select(*key, "least")
    rest = pairs.where(~F.col("first")).join(least, key, "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    rest = written_once(rest.select(*key, "level", "block", "n", "query"))
    whole = _best(near.drop("rank").unionByName(scored(rest)), k)
    count = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_products"), F.coalesce(F.sum(F.when(F.col("first"), F.col("n"))), F.lit(0)).alias("a"))
    count = count.join(rest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))).select((F.col("a") + F.col("b")).alias("products"), "all_products")
    return whole, count
