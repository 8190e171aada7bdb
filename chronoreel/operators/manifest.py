"""Question manifests: grouping flat rows, statistics, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoreel.functions.text import url_id
from chronoreel.schemas import VIDEO_ATTRIBUTES

_QUESTION = ("question_id", "task_type", "question", "options", "answer")


def group_flat(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per video with its questions, from flat question rows.

    Urls are brought to ids; a video is (video_id, url). Its attributes are those of its first row by
    ``order``, its questions sort by id as text, then by ``order``.
    """
    flat = rows.withColumn("url", url_id(F.col("videoID"), F.col("url")))
    first = F.min_by(F.struct("duration", "domain", "sub_category"), F.col(order))
    question = F.struct("question_id", F.col(order).alias("__no"), *[c for c in _QUESTION if c != "question_id"])
    grouped = flat.groupBy("video_id", "url").agg(first.alias("a"), F.array_sort(F.collect_list(question)).alias("q"))
    return grouped.select(
        "video_id", "a.duration", "a.domain", "a.sub_category", "url",
        F.transform("q", lambda x: F.struct(*[x[c].alias(c) for c in _QUESTION])).alias("questions"),
    )


def question_rows(videos: DataFrame) -> DataFrame:
    """One row per question, with its video's attributes; videos without questions vanish."""
    return videos.select(*VIDEO_ATTRIBUTES, F.explode("questions").alias("q")).select(*VIDEO_ATTRIBUTES, *[f"q.{c}" for c in _QUESTION])


def stats(videos: DataFrame) -> DataFrame:
    """(stat, key, n): totals, and videos by duration, domain, sub-category and both, questions by task type."""
    one = F.lit(1).cast("long")

    def part(stat: str, key: Column, n: Column = one) -> Column:
        return F.struct(F.lit(stat).alias("stat"), key.alias("key"), n.cast("long").alias("n"))

    own = [part(f"by_{c}", F.col(c)) for c in ("duration", "domain", "sub_category")]
    pair = part("by_duration_domain", F.concat_ws(" | ", "duration", "domain"))
    of_video = F.array(part("video_count", F.lit("")), part("question_count", F.lit(""), F.size("questions")), pair, *own)
    of_questions = F.transform("questions", lambda q: part("by_task_type", q["task_type"]))
    both = videos.select(F.inline(F.concat(of_video, of_questions)))
    totals = F.array(*[F.struct(F.lit(s).alias("stat"), F.lit("").alias("key"), F.lit(0).cast("long").alias("n")) for s in ("video_count", "question_count")])
    zero = videos.sparkSession.range(1).select(F.inline(totals))
    return both.unionByName(zero).groupBy("stat", "key").agg(F.sum("n").alias("n"))


def select_targets(videos: DataFrame, urls: list[str], order: str = "row_no") -> DataFrame:
    """The videos whose url is in the list, in its order (target_no); unknown urls are ignored; an empty list keeps all.

    The list is given by the caller and small, so it is broadcast.
    """
    if not urls:
        return videos.withColumn("target_no", F.lit(0)).orderBy(order)
    first = {u: i for i, u in reversed(list(enumerate(urls)))}
    targets = videos.sparkSession.createDataFrame(list(first.items()), "url string, target_no int")
    return videos.join(F.broadcast(targets), "url").orderBy("target_no", order)
