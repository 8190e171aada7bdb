"""The driver's tables in the shape of this engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames: a label is a video, four frames a second."""
    order = Window.partitionBy("video_key").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("video_key"), "vec_id", "embedding")
    numbered = rows.withColumn("frame_ordinal", F.row_number().over(order) - 1)
    return numbered.withColumn("time_sec", (F.col("frame_ordinal") / 4).cast("float"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a user is a video, seconds count from the first event, the value is a signal."""
    w = Window.partitionBy("video_key")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_key"), "ts", "event_id", F.col("value").cast("float").alias("signal"))
    rows = rows.withColumn("frame_ordinal", F.row_number().over(w.orderBy("ts", "event_id")) - 1)
    seconds = F.expr("timestampdiff(MICROSECOND, min(ts) OVER (PARTITION BY video_key), ts)") / 1e6
    return rows.withColumn("time_sec", seconds.cast("float")).select("video_key", "frame_ordinal", "time_sec", "signal")


def flat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as flat question rows; lang and source of the document with that id as duration and domain."""
    turns = table(spark, sf_dir, "conversations")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "lang", "source")
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return turns.join(docs, "conv_id").select(
        F.format_string("%06d", "conv_id").alias("video_id"),
        F.col("lang").alias("duration"),
        F.col("source").alias("domain"),
        F.concat(F.lit("sub"), (F.col("conv_id") % 3).cast("string")).alias("sub_category"),
        F.concat(F.lit("https://videos.example/watch?v=c"), F.col("conv_id").cast("string")).alias("url"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("videoID"),
        F.concat(F.format_string("%06d", "conv_id"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"),
        F.col("role").alias("task_type"),
        F.col("text").alias("question"),
        F.array(F.lit("A. yes"), F.lit("B. no"), F.lit("C. both"), F.lit("D. neither")).alias("options"),
        letter.alias("answer"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"),
    )


def customer_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a video catalogue to sample from: segment and nation are duration and domain."""
    return table(spark, sf_dir, "customer").select(
        F.format_string("%06d", "c_custkey").alias("video_id"),
        F.col("c_mktsegment").alias("duration"),
        F.col("c_nationkey").cast("string").alias("domain"),
        F.col("c_name").alias("url"),
        F.col("c_custkey").alias("row_no"),
    )
