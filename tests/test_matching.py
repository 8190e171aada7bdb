"""Replacements found in rounds equal those found one place after the other."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronoreel.operators import matching, sampling

VIDEO = "video_id string, duration string, domain string, url string, row_no long"


def one_after_the_other(lost, free, levels, seed):
    """The rule itself: each place takes the first free video of its best stage."""
    taken, out = set(), []
    order = sorted(free, key=lambda v: (hashlib.md5(f"{seed}|{v['url']}".encode()).hexdigest(), v["url"]))
    for slot, place in enumerate(sorted(lost, key=lambda v: (v["video_id"], v["url"]))):
        found = (None, len(levels))
        for stage, fields in enumerate(levels):
            url = next((v["url"] for v in order if v["url"] not in taken and all(v[f] == place[f] for f in fields)), None)
            if url is not None:
                found = (url, stage)
                break
        taken.add(found[0])
        out.append((slot, *found))
    return out


def catalogue(rng, n, kinds):
    return [{"video_id": f"{i:05d}", "duration": rng.choice(["s", "m", None])[:1] if kinds > 1 and rng.random() < 0.9 else "s", "domain": f"d{rng.randrange(kinds)}", "url": f"u{rng.randrange(10**9)}-{i}", "row_no": i} for i in range(n)]


@pytest.mark.parametrize("seed,n_lost,n_free,kinds,strict", [(1, 30, 200, 4, True), (2, 30, 40, 6, True), (3, 25, 30, 2, False), (4, 40, 30, 5, True), (5, 1, 0, 1, False), (6, 50, 60, 1, True)])
def test_rounds_equal_the_sequential_rule(spark, seed, n_lost, n_free, kinds, strict):
    rng = random.Random(seed)
    rng_choice = rng.choice
    rng.choice = lambda xs: rng_choice([x for x in xs if x is not None])
    rows = catalogue(rng, n_lost + n_free, kinds)
    rng.shuffle(rows)
    lost, free = rows[:n_lost], rows[n_lost:]
    levels = matching.stages(("duration", "domain"), strict)
    df = lambda xs: spark.createDataFrame([tuple(x.values()) for x in xs], VIDEO)
    order = sorted(lost, key=lambda v: (v["video_id"], v["url"]))
    places = df(order).withColumn("slot", F.expr("cast(row_number() OVER (ORDER BY video_id, url) - 1 AS int)"))
    found, rounds = matching.match(places, df(free), levels, 7)
    assert sorted(tuple(r) for r in found.collect()) == one_after_the_other(lost, free, levels, 7)
    assert rounds <= n_lost + len(levels) if n_free < n_lost else rounds <= 12


def test_many_places_of_one_list_are_one_round(spark):
    """Places that agree do not wait for each other."""
    rows = [{"video_id": f"{i:05d}", "duration": "s", "domain": "d", "url": f"u{i}", "row_no": i} for i in range(900)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], VIDEO)
    places = df.where("row_no < 400").withColumn("slot", F.col("row_no").cast("int"))
    found, rounds = matching.match(places, df.where("row_no >= 400"), matching.stages(("duration", "domain"), True), 7)
    assert rounds == 1 and found.select("url").distinct().count() == 400
    plan = sampling.replacement_candidates(places, df, df.where("row_no < 400"), df.limit(0), 400, enforce_duration=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_left_and_nothing_lost(spark):
    rows = [(f"{i}", "s", "d", f"u{i}", i) for i in range(4)]
    df = spark.createDataFrame(rows, VIDEO)
    sample = df.where("row_no < 3")
    with pytest.raises(RuntimeError, match="no video is left to replace u1"):
        matching.replace_lost(sample, df, df.where("row_no in (2, 3)"))
    out, log = matching.replace_lost(sample, df, df)
    assert out.count() == 3 and log.count() == 0
    out, log = matching.replace_lost(sample, df, df.where("row_no <> 1"))
    assert [tuple(r) for r in log.collect()] == [(0, "u1", "u3", 0, "unavailable")] and {r["url"] for r in out.collect()} == {"u0", "u2", "u3"}
