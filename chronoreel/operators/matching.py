"""Replacements for the lost places of a sample, found in rounds by Spark instead of one after the other.

The rule is sequential: places choose in order, each the first free video of its best stage (same bucket, same duration,
and so on), and a chosen video is gone for the later ones. As earlier places come first everywhere, that is the one stable
matching, so it is also what rounds of proposals end in: every unmatched place proposes, each video keeps the first place
that has asked, the others go on. Places that look through one list propose together, the k-th of them to the k-th video
that would still take the first, so a list with many lost places is no chain of rounds. Lists are cut to as many videos
as there are places, since no more can ever be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.operators.sampling import _digest
from chronoreel.plans.store import written_once


def stages(bucket_fields: tuple[str, ...], enforce_duration: bool) -> list[list[str]]:
    """The fields that a replacement shares with what it replaces, best stage first."""
    bucket = list(bucket_fields)
    return [list(dict.fromkeys(["duration", *bucket])), ["duration"], bucket, []] if enforce_duration else [bucket, []]


def list_key(fields: list[str]) -> Column:
    """Equal for rows that agree in the fields, nulls included."""
    return F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(c) for c in fields])) if fields else F.lit("")


def offers(free: DataFrame, levels: list[list[str]], most: int, seed: int) -> DataFrame:
    """(stage, list, url, tie): for each stage and list its first ``most`` videos by digest and url."""
    out = None
    for stage, fields in enumerate(levels):
        rows = free.select(F.lit(stage).alias("stage"), list_key(fields).alias("list"), "url", _digest(seed, F.col("url")).alias("tie"))
        if fields:
            place = F.row_number().over(Window.partitionBy("list").orderBy("tie", "url"))
            rows = rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
        else:
            rows = rows.orderBy("tie", "url").limit(most)
        out = rows if out is None else out.unionAll(rows)
    return out


def match(places: DataFrame, free: DataFrame, levels: list[list[str]], seed: int = 7) -> tuple[DataFrame, int]:
    """``places`` (slot, unique, and the fields) matched with ``free`` videos: (slot, url, stage), and the rounds it took.

    url is null for a place that nothing was left for.
    """
    slots = places.select("slot", F.array(*[list_key(f) for f in levels]).alias("lists"), F.lit(0).alias("stage"), F.lit(None).cast("string").alias("url"))
    now = written_once(slots)
    most = now.count()
    lists = written_once(offers(free, levels, most, seed))
    rounds = 0
    while True:
        asking = now.where(F.col("url").isNull() & (F.col("stage") < len(levels))).select("slot", "stage", F.get("lists", F.col("stage")).alias("list"))
        if asking.isEmpty():
            return now.select("slot", "url", "stage"), rounds
        rounds += 1
        own = Window.partitionBy("stage", "list")
        asking = asking.withColumn("k", F.row_number().over(own.orderBy("slot")))
        first = asking.where(F.col("k") == 1).select("stage", "list", F.col("slot").alias("first"))
        held = now.where(F.col("url").isNotNull()).select("url", F.col("slot").alias("holder"))
        still = lists.join(first, ["stage", "list"]).join(held, "url", "left").where(F.col("holder").isNull() | (F.col("holder") > F.col("first")))
        still = still.withColumn("k", F.row_number().over(own.orderBy("tie", "url"))).select("stage", "list", "k", F.col("url").alias("asked"))
        asked = asking.join(still, ["stage", "list", "k"], "left").select("slot", "asked")
        wins = held.select("url", F.col("holder").alias("slot")).unionAll(asked.where(F.col("asked").isNotNull()).select(F.col("asked").alias("url"), "slot"))
        wins = wins.groupBy("url").agg(F.min("slot").alias("slot")).select("slot", F.col("url").alias("won"))
        # A place whose list has nothing left for it looks at its next list; one that was outbid asks again.
        over = asked.where(F.col("asked").isNull()).select("slot", F.lit(1).alias("on"))
        after = now.join(wins, "slot", "left").join(over, "slot", "left")
        now = written_once(after.select("slot", "lists", (F.col("stage") + F.coalesce("on", F.lit(0))).alias("stage"), F.col("won").alias("url")))


def replace_lost(
    sampled: DataFrame, videos: DataFrame, available: DataFrame, seed: int = 7, bucket_fields: tuple[str, ...] = ("duration", "domain"), enforce_duration: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The sample with unavailable videos replaced, and the log (slot, replaced_url, replacement_url, stage, reason) in the order of video_id and url.

    Only available videos are tried. A RuntimeError if nothing is left for a place.
    """
    here = available.select("url").distinct()
    good, lost = sampled.join(here, "url", "left_semi"), sampled.join(here, "url", "left_anti")
    # A sample is small, so one task may number its lost places.
    numbered = written_once(lost.withColumn("slot", F.row_number().over(Window.orderBy("video_id", "url")) - 1))
    taken = good.select("url").unionAll(lost.select("url"))
    free = videos.join(here, "url", "left_semi").join(taken, "url", "left_anti")
    found, _ = match(numbered, free.dropDuplicates(["url"]), stages(bucket_fields, enforce_duration), seed)
    log = written_once(numbered.select("slot", F.col("url").alias("replaced_url")).join(found, "slot").select("slot", "replaced_url", F.col("url").alias("replacement_url"), "stage", F.lit("unavailable").alias("reason")))
    for r in log.where(F.col("replacement_url").isNull()).orderBy("slot").limit(1).collect():
        raise RuntimeError(f"no video is left to replace {r['replaced_url']}")
    chosen = log.select(F.col("replacement_url").alias("url"))
    return good.unionByName(videos.join(chosen, "url", "left_semi").select(*good.columns)), log
