"""What a faster but smaller job would miss."""

import random

import corpus_pipeline
import numpy as np
import pytest

from chronoreel.llm import html_text, maxent_lm, near_copies


def test_words_depend_on_the_word_before_the_last():
    counts = np.arange(6000, 0, -1)
    head = maxent_lm.Head({b"w%d" % i: i for i in range(len(counts))}, counts, int(counts.sum()), len(counts))
    assert maxent_lm.CLASSES >= 64 and len(set(head.cls.tolist())) == maxent_lm.WIDTH
    # Two words of one class: which comes next is told by the word before the last only: 5039 after 3, 5041 after 5.
    assert head.cls[5039] == head.cls[5041]
    w2 = np.repeat([3, 5], 500)
    seen = np.where(w2 == 3, 5039, 5041)
    asked2, asked = np.array([3, 3, 5, 5]), np.array([5039, 5041, 5039, 5041])
    x, w2 = (np.concatenate(v).astype(np.uint32) for v in ((seen, asked), (w2, asked2)))
    w1, train = np.full(len(x), 2, np.uint32), np.arange(len(x)) < len(seen)
    order = maxent_lm.in_order(x, w1, w2, len(counts))
    bucket = maxent_lm.Bucket(head, x[order], w1[order], w2[order], train[order])
    found = np.empty(len(x))
    found[order] = bucket.log_probabilities(np.zeros((maxent_lm.ROWS, maxent_lm.WIDTH), np.float32))
    p = found[len(seen) :]
    assert p[0] > p[1] + 1 and p[3] > p[2] + 1


def _sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_of_each_by_jaccard_of_five_words(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for size in [100] * 12 + [40] * 6 + [300] * 4:
        words = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for edits in (0, 1, 1, 2, 3):
            copy = list(words)
            for _ in range(edits if size > 40 else min(edits, 1)):
                copy[rng.randrange(size)] = "edited"
            texts.append(" ".join(copy))
    texts += [texts[0], "", "  ", "one two", "One  two", "a b c"]
    docs = [(i, x) for i, x in enumerate(texts)] + [(5, "Another text of the same id, which is of no group at all.")]
    up = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            x, y = _sets(docs[i][1]), _sets(docs[j][1])
            if len(x & y) >= 0.8 * len(x | y):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if u == old else u for u in up]
    want = sorted(docs[i] for i in set(up))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for few in (8, 0):
        monkeypatch.setattr(near_copies, "FEW", few)
        assert sorted(tuple(r) for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == want


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(9)
    one, two, three = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(3))
    # Id 1 is the first of two groups; id 2 stands on a copy of the second and on a text of its own.
    docs = [(1, one), (1, two), (2, two), (2, three), (3, one)]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(1, one), (1, two), (2, three)])


SENTENCE = "The river rose over the road in the night, and in the morning the house stood in a wide and quiet lake."


@pytest.mark.parametrize(
    "page",
    [
        '<svg class="icon" /><article><p>%s</p></article>',
        "<math/><article><p>%s</p></article>",
        '<object data="x.swf"><article><p>%s</p></article>',
        "<article><object><p>%s</p></object></article>",
        "<title-card><p>%s</p></title-card>",
        '<div class="with-sidebar"><article><p>%s</p></article></div>',
        '<div class="page no-sidebar"><article><p>%s</p></article></div>',
    ],
)
def test_text_after_and_inside_odd_tags(page):
    assert SENTENCE in " ".join(b.text for b in html_text.blocks_of(page % SENTENCE))
    assert SENTENCE in html_text.main_text("<html><body>" + page % SENTENCE + "</body></html>")


def test_drawings_and_sidebars_stay_out():
    page = f'<body><svg viewBox="0 0 1 1"><text>Drawn words.</text></svg><article><p>{SENTENCE}</p></article><div class="sidebar"><p>{SENTENCE[::-1]}</p></div></body>'
    assert html_text.main_text(page).strip() == SENTENCE
