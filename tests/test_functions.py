import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronoreel.config import AnswerConfig, IndexConfig, RetrievalConfig, batch_size, parse_quotas
from chronoreel.functions import text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("n", "k", "picks"),
    [(10, 4, [0, 3, 6, 9]), (6, 3, [0, 2, 5]), (4, 3, [0, 2, 3]), (11, 4, [0, 3, 7, 10]), (11, 1, [0]), (3, 8, [0, 0, 1, 1, 1, 1, 2, 2]), (1, 3, [0, 0, 0]), (0, 3, []), (5, 0, [])],
)
def test_even_picks(spark, n, k, picks):
    assert one(spark, vectors.even_picks(F.lit(n), k)) == picks


def test_even_picks_halves_go_to_even(spark):
    rng = random.Random(4)
    cases = [(rng.randint(1, 300), rng.randint(2, 20)) for _ in range(300)]
    rows = spark.createDataFrame(cases, "n int, k int").select("n", "k", vectors.even_picks(F.col("n"), F.col("k")).alias("p")).collect()
    for r in rows:
        assert r["p"] == [round(Fraction((r["n"] - 1) * i, r["k"] - 1)) for i in range(r["k"])]


def test_uniform_picks(spark):
    assert one(spark, vectors.uniform_picks(F.lit(3), 8)) == [0, 1, 2]
    assert one(spark, vectors.uniform_picks(F.lit(0), 8)) == []
    assert one(spark, vectors.uniform_picks(F.lit(10), 4)) == [0, 3, 6, 9]


def test_l2_normalize(spark):
    assert one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


@pytest.mark.parametrize(
    ("said", "letter"),
    [("B", "B"), ("the answer is (b).", "B"), ("a cat, so C", "A"), ("none", None), ("AB", None), ("E", None), ("", None), ("éa é b", "B"), (None, None)],
)
def test_parse_letter(spark, said, letter):
    assert one(spark, text.parse_letter(F.lit(said).cast("string"))) == letter


def test_query_text_keeps_the_line_break(spark):
    assert one(spark, text.query_text(F.lit("Q"), F.array(F.lit("x"), F.lit("y")))) == "Q\nx\ny"
    assert one(spark, text.query_text(F.lit("Q"), F.array().cast("array<string>"))) == "Q\n"


@pytest.mark.parametrize(
    ("given", "url", "out"),
    [("abc", "u", "abc"), (None, "https://www.youtube.com/watch?v=abc&t=1", "abc&t=1"), ("", "xyz", "xyz"), (None, "a?watch?v=b?watch?v=c", "b?watch?v=c")],
)
def test_url_id(spark, given, url, out):
    assert one(spark, text.url_id(F.lit(given).cast("string"), F.lit(url))) == out


@pytest.mark.parametrize(("position", "seconds", "tag"), [(3, 0.125, "03_0_12s"), (3, 12.5, "03_12_50s"), (12, 0.375, "12_0_38s"), (0, 1234.0, "00_1234_00s")])
def test_frame_tag(spark, position, seconds, tag):
    assert one(spark, text.frame_tag(F.lit(position), F.lit(seconds))) == tag


def test_segment_id(spark):
    assert one(spark, text.segment_id(F.lit("low"), F.lit(7))) == "low_0007"


def test_settings_are_checked():
    with pytest.raises(ValueError, match="weights"):
        IndexConfig(openclip_weight=0, dino_weight=0, energy_weight=0)
    with pytest.raises(ValueError, match="at least 1"):
        RetrievalConfig(top_low=0)
    assert AnswerConfig().max_new_tokens == 32
    assert [batch_size(x) for x in (None, 0, -1, 5)] == [1, 1, 1, 5]
    assert parse_quotas(["short=10", "long=3"]) == {"short": 10, "long": 3}
    with pytest.raises(ValueError, match="name=count"):
        parse_quotas(["short"])
