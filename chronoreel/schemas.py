"""Schemas of the tables that operators pass on. Every table is keyed by ``video_key``."""

from pyspark.sql import types as T

QUESTION = "question_id string, task_type string, question string, options array<string>, answer string"
FLAT_ROW = f"video_id string, duration string, domain string, sub_category string, url string, videoID string, {QUESTION}"
VIDEO_ATTRIBUTES = ("video_id", "duration", "domain", "sub_category", "url")
NESTED_VIDEO = (
    "video_id string, duration string, domain string, sub_category string, url string, questions array<struct<"
    "question_id:string,task_type:string,question:string,options:array<string>,answer:string>>"
)
FRAMES = "video_key string, frame_ordinal int, native_index bigint, time_sec float, native_fps double"
SEGMENT_SCAN = (
    "video_key string, level string, segment_no int, start_index int, end_index int, start_time_sec double, end_time_sec double, "
    "duration_sec double, peak_score double, mean_score double"
)
PREDICTION = "raw_text string, generation_sec double"


def required(schema: str, nullable: tuple[str, ...] = ()) -> T.StructType:
    """A DDL schema whose columns, but for ``nullable``, must be there in JSON input."""
    out = T._parse_datatype_string(schema)
    return T.StructType([T.StructField(f.name, f.dataType, f.name in nullable) for f in out.fields])
