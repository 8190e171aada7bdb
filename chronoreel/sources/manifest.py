"""Manifests from JSON or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoreel import schemas
from chronoreel.operators.manifest import group_flat
from chronoreel.sources.files import as_folder, documents, list_partitioned

DOCUMENT = 64 << 20  # bytes; a folder with a larger document is left to Spark's JSON reader


def _numbered(df: DataFrame) -> DataFrame:
    """Input order as row_no. A manifest is one JSON document, so one partition holds it anyway."""
    return df.withColumn("__i", F.monotonically_increasing_id()).withColumn("row_no", F.row_number().over(Window.orderBy("__i"))).drop("__i")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Videos with nested questions, in order (row_no).

    The file holds an object with ``videos``, a list of nested videos, or a list of flat question rows. A
    missing ``questions`` is an empty list; nulls in other columns are refused.

    A folder of such files is one manifest (without videos if it holds none). Its documents are listed, looked into and
    read in tasks; row_no then has gaps, and rises inside a document, or with video and url for flat rows.
    """
    root = as_folder(spark, path)
    if root is not None:
        found = documents(list_partitioned(spark, root), root, DOCUMENT)
        probe = _keys(found)
        if None not in probe:
            return _read_documents(found, path, probe)
    probe = spark.read.option("multiLine", True).json(path).schema.names
    if "videos" in probe:
        rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"videos array<struct<{_struct(schemas.NESTED_VIDEO)}>>").json(path)
        videos = _numbered(rows.select(F.explode("videos").alias("v")).select("v.*"))
    elif "question_id" in probe:
        flat = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schemas.FLAT_ROW).json(path)
        videos = group_flat(_refuse_nulls(_numbered(flat), "videoID"))
        return _numbered(videos.orderBy("video_id", "url"))
    elif "url" in probe:
        videos = _numbered(spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schemas.NESTED_VIDEO).json(path))
    else:
        raise ValueError(f"{path} is not a manifest: it has {probe}")
    return _with_questions(videos)


def _keys(found: DataFrame) -> list[str | None]:
    """Keys that documents (text), or what they list, have on top; "" for objects without any, None if a text is missing."""
    listed = F.when(F.ltrim("text", F.lit(" \t\r\n")).startswith("{"), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    objects = F.from_json(listed, "array<map<string,string>>")
    names = F.flatten(F.transform(objects, lambda x: F.when(F.size(x) == 0, F.array(F.lit(""))).otherwise(F.map_keys(x))))
    return [r[0] for r in found.select(F.explode(F.when(F.col("text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(names))).distinct().collect()]


def _read_documents(found: DataFrame, path: str, probe: list[str]) -> DataFrame:
    """``read_manifest`` of documents (text) with such keys."""

    def rows(schema: str) -> DataFrame:
        return found.select(F.inline(F.from_json("text", f"array<struct<{_struct(schema)}>>", {"mode": "FAILFAST"})))

    number = F.monotonically_increasing_id()
    if "videos" in probe or not probe:
        videos = rows(f"videos array<struct<{_struct(schemas.NESTED_VIDEO)}>>").select(F.inline("videos")).withColumn("row_no", number)
    elif "question_id" in probe:
        flat = rows(schemas.FLAT_ROW).withColumn("row_no", number)
        return group_flat(_refuse_nulls(flat, "videoID")).orderBy("video_id", "url").withColumn("row_no", number)
    elif "url" in probe:
        videos = rows(schemas.NESTED_VIDEO).withColumn("row_no", number)
    else:
        raise ValueError(f"{path} is not a manifest: it has {sorted(filter(None, probe))}")
    return _with_questions(videos)


def _with_questions(videos: DataFrame) -> DataFrame:
    return _refuse_nulls(videos.withColumn("questions", F.coalesce("questions", F.array().cast(videos.schema["questions"].dataType))))


def read_question_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Videos with nested questions from a table of flat question rows, such as a local export of a hub dataset.

    row_no rises in the order of video and url; a table of any size is sorted by ranges, so it has gaps.
    """
    names = [x.split()[0] for x in schemas.FLAT_ROW.split(", ")]
    rows = spark.read.format(kind).load(path)
    flat = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])
    numbered = _refuse_nulls(flat.withColumn("row_no", F.monotonically_increasing_id()), "videoID")
    return group_flat(numbered).orderBy("video_id", "url").withColumn("row_no", F.monotonically_increasing_id())


def _struct(ddl: str) -> str:
    """A column list as the inside of a struct type."""
    out, depth = [], 0
    for part in ddl.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def _refuse_nulls(df: DataFrame, *allowed: str) -> DataFrame:
    checks = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)).alias(c) if c not in (*allowed, "row_no") else F.col(c) for c in df.columns]
    return df.select(*checks)
