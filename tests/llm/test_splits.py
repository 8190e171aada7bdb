"""Scores do not follow how many tasks read the documents."""

import random

import numpy as np

from chronoreel.llm import maxent_lm


def test_scores_are_the_same_for_any_number_of_splits(spark):
    """Two words above the limit at which pairs are dealt out, two buckets."""
    rng = random.Random(5)
    docs = []
    for i in range(1250):
        words = rng.choices(["the", "of", "river", "stone", f"w{rng.randrange(300)}"], weights=[40, 40, 8, 8, 4], k=1000)
        docs.append((i if i % 50 else None, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def scores(parts):
        rows = maxent_lm.score(df.repartition(parts)).select("doc_id", "n_tokens", "base_score", "score").collect()
        return sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["base_score"], 4), r["score"]) for r in rows)

    one, many = scores(1), scores(7)
    assert [x[:3] for x in one] == [x[:3] for x in many]
    assert np.allclose([x[3] for x in one], [x[3] for x in many], rtol=1e-6)


def test_events_of_a_text_have_one_bucket_wherever_it_is_read():
    counts = np.array([4_000_000, 3_000_000, 2_000, 10])
    head = maxent_lm.Head({b"w%d" % i: i for i in range(4)}, counts, int(counts.sum()), 4)
    rng = np.random.default_rng(1)
    w1, w2, salt = (rng.integers(0, n, 5000).astype(np.uint32) for n in (4, 4, 40))
    whole = head.bucket_of(w1, w2, salt)
    parts = np.concatenate([head.bucket_of(w1[a : a + 700], w2[a : a + 700], salt[a : a + 700]) for a in range(0, 5000, 700)])
    assert (whole == parts).all() and len(np.unique(whole[(w1 == 0) & (w2 == 0)])) > 4
