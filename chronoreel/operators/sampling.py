"""Stratified samples with quotas and replacement.

Sizes per stratum follow a closed form over running sums, so only the table of strata (one row each) is
ordered; members are ranked by a digest of seed and url. Which members are drawn therefore differs from a
seeded shuffle, how many does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary"))


def stratum_targets(strata: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``strata`` (size, n, first, and group columns) with target: how many each stratum gives.

    Each gives its share rounded down, one at least. What is too much is taken from the largest shares,
    each down to one; what is missing goes to the largest remainders, each up to its size.
    """
    w = Window.partitionBy(*(group or []))
    shared = strata.withColumn("raw", F.col("size") * (F.col("n") / F.sum("n").over(w)))
    shared = shared.withColumn("base", F.least("n", F.greatest(F.lit(1), F.floor("raw"))))
    shared = shared.withColumn("excess", F.sum("base").over(w) - F.col("size"))
    down = w.orderBy(F.col("base").desc(), F.col("n").desc(), "first").rowsBetween(Window.unboundedPreceding, -1)
    up = w.orderBy((F.col("raw") - F.floor("raw")).desc(), "first").rowsBetween(Window.unboundedPreceding, -1)
    spare, room = F.col("base") - 1, F.col("n") - F.col("base")
    took, gave = F.coalesce(F.sum(spare).over(down), F.lit(0)), F.coalesce(F.sum(room).over(up), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("excess") - took, spare))
    give = F.greatest(F.lit(0), F.least(-F.col("excess") - gave, room))
    target = F.when(F.col("size") <= 0, 0).when(F.col("size") >= F.sum("n").over(w), F.col("n")).otherwise(F.col("base") - take + give)
    return shared.withColumn("target", target.cast("long")).drop("raw", "base", "excess")


def _drawn(videos: DataFrame, targets: DataFrame, fields: list[str], seed: int, most: int) -> DataFrame:
    """The first ``target`` members of each stratum. None gives more than ``most``, so tasks cut strata before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*fields).orderBy(_digest(seed, F.col("url")), "url"))
    first = videos.withColumn("__rank", rank).where(F.col("__rank") <= most)
    return first.join(targets.select(*fields, "target"), fields).where(F.col("__rank") <= F.col("target")).select(*videos.columns)


def stratified_sample(videos: DataFrame, sample_size: int, seed: int = 7, bucket_fields: tuple[str, ...] = ("duration", "domain"), order: str = "row_no") -> DataFrame:
    """``sample_size`` videos, spread over the buckets in proportion; all of them if there are no more.

    A ValueError if a sample is asked for that has fewer rows than there are buckets.
    """
    fields = list(bucket_fields)
    strata = videos.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).withColumn("size", F.lit(sample_size))
    total = strata.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if 0 < sample_size < min(total["k"], total["n"] or 0):
        raise ValueError(f"{sample_size} rows cannot cover {total['k']} buckets")
    return _drawn(videos, stratum_targets(strata), fields, seed, max(0, sample_size))


def quota_sample(videos: DataFrame, quotas: dict[str, int], seed: int = 7, bucket_fields: tuple[str, ...] = ("duration", "domain"), order: str = "row_no") -> DataFrame:
    """A stratified sample of the given size within each duration; durations without a quota give nothing.

    All durations are drawn in one pass. A ValueError if a quota exceeds its videos or is below its buckets.
    """
    fields = list(dict.fromkeys(["duration", *bucket_fields]))
    wanted = F.broadcast(videos.sparkSession.createDataFrame(list(quotas.items()), "duration string, size int"))
    strata = videos.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    have = strata.groupBy("duration").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).join(wanted, "duration", "right")
    for r in have.where((F.coalesce("n", F.lit(0)) < F.col("size")) | ((F.col("size") > 0) & (F.col("size") < F.col("n")) & (F.col("size") < F.col("k")))).collect():
        raise ValueError(f"quota {r['size']} for {r['duration']!r}: {r['n'] or 0} videos in {r['k'] or 0} buckets")
    return _drawn(videos, stratum_targets(strata.join(wanted, "duration"), ["duration"]), fields, seed, max([0, *quotas.values()]))


def replacement_candidates(
    slots: DataFrame, videos: DataFrame, active: DataFrame, failed: DataFrame, most: int, seed: int = 7, bucket_fields: tuple[str, ...] = ("duration", "domain"), enforce_duration: bool = False
) -> DataFrame:
    """Ranked replacements: for each slot (slot, duration and bucket fields) the videos that are neither active nor failed.

    stage is 0 for the best match; within it a digest of seed and url orders. Of each stage the first ``most``
    are offered, and as each choice uses up one, as many as there are slots are enough. They are found once
    for each list (a bucket, a duration, or all), and slots meet them by that list.
    """
    from chronoreel.operators import matching

    free = videos.join(active.select("url"), "url", "left_anti").join(failed.select("url"), "url", "left_anti")
    levels = matching.stages(bucket_fields, enforce_duration)
    lists = matching.offers(free, levels, most, seed)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), matching.list_key(fields).alias("list")) for k, fields in enumerate(levels)]))
    found = slots.select("slot", wanted.alias("w")).select("slot", "w.*").join(lists, ["stage", "list"])
    return found.groupBy("slot", "url").agg(F.min("stage").alias("stage"), F.first("tie").alias("tie"))


def validate_and_replace(
    sampled: DataFrame, videos: DataFrame, available: DataFrame, seed: int = 7, bucket_fields: tuple[str, ...] = ("duration", "domain"), enforce_duration: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The sample with unavailable videos replaced, and the log (replaced_url, replacement_url, reason) in the order of places.

    Found in rounds (``matching``), with the result of filling one place after the other. Only available videos
    are tried, so the log has no failed attempts in between. A RuntimeError if nothing is left for a place.
    """
    from chronoreel.operators import matching

    out, log = matching.replace_lost(sampled, videos, available, seed, bucket_fields, enforce_duration)
    return out, log.orderBy("slot").select("replaced_url", "replacement_url", "reason")
