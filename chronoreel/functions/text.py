"""Text expressions: queries, prompts, answers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_text(question: Column, options: Column) -> Column:
    """The question and its options, one a line; without options a line break still ends the question."""
    return F.concat(question, F.lit("\n"), F.array_join(options, "\n"))


# The wording that answers are asked for with.
INSTRUCTION = "Answer the multiple-choice question using only the evidence shown.\nReply with only one letter: A, B, C, or D.\n\n"


def mcq_prompt(question: Column, options: Column, prefix: str = "") -> Column:
    """A prompt that asks for the letter of the right option only."""
    return F.concat(F.lit(f"{prefix}\n{INSTRUCTION}Question: "), question, F.lit("\nOptions:\n"), F.array_join(options, "\n"))


def parse_letter(text: Column) -> Column:
    """The first of A-D that stands alone in the upper-cased text (so the article "a" counts), else null."""
    return F.nullif(F.regexp_extract(F.upper(text), r"(?U)\b([A-D])\b", 1), F.lit(""))


def url_id(video_id: Column, url: Column) -> Column:
    """The given id if not empty, else what follows the first ``watch?v=`` in the url, else the url."""
    mark = "watch?v="
    at = F.instr(url, mark)
    tail = F.when(at > 0, url.substr(at + len(mark), F.length(url))).otherwise(url)
    return F.coalesce(F.nullif(video_id, F.lit("")), tail)


def segment_id(level: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", level, number)


def frame_tag(position: Column, seconds: Column) -> Column:
    """``NN_<seconds with two decimals>s`` with an underscore for the point; halves go to even."""
    value = F.bround(seconds.cast("decimal(38,20)"), 2).cast("decimal(38,2)").cast("string")
    return F.concat(F.format_string("%02d_", position), F.replace(value, F.lit("."), F.lit("_")), F.lit("s"))
