"""Judging answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.functions.text import parse_letter


def judged(answers: DataFrame) -> DataFrame:
    """``answers`` (raw_text, gold_letter) with predicted_letter and choice_correct; no letter is wrong."""
    out = answers.withColumn("predicted_letter", parse_letter(F.col("raw_text")))
    return out.withColumn("choice_correct", F.col("predicted_letter").eqNullSafe(F.col("gold_letter")) & F.col("predicted_letter").isNotNull())


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """n_questions and choice_accuracy, 0 without questions; per group if columns are named."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_questions"), F.coalesce(F.avg(F.col("choice_correct").cast("double")), F.lit(0.0)).alias("choice_accuracy")
    )


def result_rows(questions: DataFrame, predictions: DataFrame, **nested: DataFrame) -> DataFrame:
    """One row per question with its video's attributes, the answer and nested lists.

    Each keyword is a DataFrame with video_key, question_id and a struct column of that name and an order
    column ``position`` or ``rank``; a question without rows there has an empty list.
    """
    out = judged(questions.withColumn("gold_letter", F.col("answer")).join(predictions, ["video_key", "question_id"], "left"))
    for name, rows in nested.items():
        order = "rank" if "rank" in rows.columns else "position"
        fields = [c for c in rows.columns if c not in ("video_key", "question_id", order)]
        lists = rows.groupBy("video_key", "question_id").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))
        out = out.join(lists, ["video_key", "question_id"], "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out.drop("answer")
