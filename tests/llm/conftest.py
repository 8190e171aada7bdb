import random

import pytest

WORDS = "the of and to in that is was for on with as it at by from stone river light wind house road field winter morning letter table garden".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, fp string, word string, key string, score string, quality string"


def prose(rng, n):
    words = rng.choices(WORDS, k=n)
    return " ".join(w.title() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, null ids, clashing column names."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n ", "en", None), (None, "Without id.", "en", "s1"), (None, None, None, None)]
    rows += [(103, prose(rng, 30_000), "en", "s2"), (104, rows[3][1], "fr", "s1"), (105, rows[3][1], "de", "s3"), rows[7], rows[7], (106, "é ü 你好  x", "de", "s1")]
    rows += [(107, "Word " * 500, "en", "s3"), (108, 'token = "0123456789abcdef0123456789abcdef01234567" ', "en", "s0")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["clash"] * 7) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
