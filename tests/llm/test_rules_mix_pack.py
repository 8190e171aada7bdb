import itertools
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoreel.llm import mixing, packing, quality_rules

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain(x):
    if str(x) in ("None", "nan", "<NA>"):
        return "~"
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def table(pdf):
    return sorted(tuple(map(plain, row)) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(odd_docs):
    con = duckdb.connect()
    con.register("pdf", odd_docs.select("doc_id", "text", "source").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM pdf")
    return con


def test_rules_equal_plain_python(odd_docs):
    rows = quality_rules.measure(odd_docs.withColumn("row", F.monotonically_increasing_id()), id_col="row").collect()
    texts = {r["row"]: r["text"] or "" for r in odd_docs.withColumn("row", F.monotonically_increasing_id()).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        words = SPLIT.findall(text)
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if SPLIT.search(x)]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_rules_many_repeats_take_the_sorting_path(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 9)}" for _ in range(3000)]
    row = quality_rules.measure(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    assert row["n_repeat_words"] == len({i + k for i in range(2998) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_rules_equal_their_sql(odd_docs, duck):
    assert table(quality_rules.measure(odd_docs).toPandas()) == table(duck.execute(quality_rules.ORACLE).df())


def test_rules_verdicts_and_cleaning(spark, no_docs):
    rng = random.Random(6)

    def line(n, end):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + end

    good = "\n".join(line(12, ".") for _ in range(12))
    bad = "\n".join(x for _ in range(12) for x in (line(3, ""), line(9, "").upper(), "click here " + line(6, "."), "| " + line(5, " | * | # |")))
    df = spark.createDataFrame([(1, good), (2, bad), (3, good + "\nMenu\n\nLast one.")], "doc_id long, text string")
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.measure(df).collect()} == {1: (False, True), 2: (False, False), 3: (False, True)}
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.clean(df).collect()}
    assert cleaned[1] == good and cleaned[3] == good + "\n\nLast one." and cleaned[2] == ""
    assert quality_rules.measure(no_docs).count() == 0


def test_mix_equals_its_sql(odd_docs, duck):
    unique = odd_docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    duck.register("one", unique.select("doc_id", "text", "source").toPandas())
    sql = mixing.ORACLE.replace("FROM documents", "FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM one)")
    assert table(mixing.mix(unique).toPandas()) == table(duck.execute(sql).df())


def test_mix_properties(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).toPandas()
    assert len(rows) == odd_docs.count() and (rows.taken <= 3 * rows["size"]).all()
    per = rows.groupby(rows.source.fillna("~")).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.source_size).all() and abs(per.target.sum() - per["size"].sum()) < 1e-6
    assert (per.target <= 3 * per.source_size + 1e-9).all()
    again = mixing.mix(odd_docs.repartition(7)).toPandas()
    assert table(rows) == table(again)
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat(no_docs).count() == 0


def test_a_long_document_does_not_end_the_draw(spark):
    rng = random.Random(4)
    sizes = {"a": [40_000, *(rng.randint(20, 400) for _ in range(400))], "b": [rng.randint(20, 400) for _ in range(300)], "c": [30_000, *(rng.randint(20, 400) for _ in range(350))]}
    docs = [(f"{s}{i}", s, "w " * n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame([(i, s, t) for i, (_, s, t) in enumerate(docs)], "doc_id long, source string, text string")
    rows = mixing.mix(df).toPandas()
    per = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) <= 400).all(), per


def test_inclusion_odds_change_the_sample(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * rng.choice((20, 20, 20, 400))) for i in range(2000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs).toPandas()
    rows["copies"] = rows.taken // rows["size"]
    part = rows[rows.source == "b"]
    short, long = (part[part["size"] == n].copies.mean() for n in (20, 400))
    assert part.copies.max() == part.copies.min() + 1 and short > long + 0.2  # long texts have the lower odds
    # With odds that ignore the size, both kinds have the same chance.
    even = mixing.mix(docs, by_size=0).toPandas()
    even["copies"] = even.taken // even["size"]
    same = even[even.source == "b"]
    assert abs(same[same["size"] == 20].copies.mean() - same[same["size"] == 400].copies.mean()) < 0.1
    assert set(same[same.copies > same.copies.min()].doc_id) != set(part[part.copies > part.copies.min()].doc_id)


def test_targets_reshare_what_caps_leave(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes)


def test_repeat_gives_the_taken_rows(odd_docs):
    taken = mixing.mix(odd_docs).groupBy("source").agg(F.sum("taken").alias("t")).toPandas()
    mixed = mixing.repeat(odd_docs)
    assert mixed.columns == odd_docs.columns
    got = mixed.select("source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).toPandas()
    assert dict(zip(got.source, got.n, strict=True)) == {s: t for s, t in zip(taken.source, taken.t, strict=True) if s in set(got.source)}


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(300):
        histogram = sorted({rng.randint(0, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}.items())
        k = rng.randint(1, 5)
        lengths = [x for x, _ in histogram]
        best = min(packing.padded(histogram, sorted({*c, lengths[-1]})) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths, m))
        got = packing.optimal_boundaries(histogram, k)
        assert len(got) <= k and got[-1] == lengths[-1] and packing.padded(histogram, got) == best


def test_long_lengths_are_exact(spark):
    lengths = [8000, 8193, 8194, 8200, 16_385, 16_386, 20_000, 20_001]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(docs, buckets=5).toPandas()
    histogram = [(n, 1) for n in lengths]
    best = min(packing.padded(histogram, sorted({*c, 20_001})) for c in itertools.combinations(lengths, 4))
    assert rows.bucket_len.sum() == best and sorted(rows.n_tokens) == lengths


def test_pack_equals_its_sql(odd_docs, duck):
    unique = odd_docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    duck.register("texts4", unique.select("doc_id", "text").toPandas())
    sql = packing.ORACLE.replace("FROM documents", "FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM texts4)")
    assert table(packing.pack(unique).toPandas()) == table(duck.execute(sql).df())


def test_pack(odd_docs, no_docs):
    rows = packing.pack(odd_docs, buckets=4, budget=300).toPandas()
    assert len(rows) == odd_docs.count()
    assert (rows.n_tokens <= rows.bucket_len).all() and (rows.padding == rows.bucket_len - rows.n_tokens).all()
    batches = rows.groupby(["bucket_id", "batch_no"])
    assert all(sorted(g.slot) == list(range(len(g))) and (len(g) == 1 or len(g) * g.bucket_len.iloc[0] <= 300) for _, g in batches)
    for _, b in rows.groupby("bucket_id"):
        full = max(1, 300 // max(1, b.bucket_len.iloc[0]))
        assert (b.batch_no.value_counts() < full).sum() <= 1
    histogram = sorted(Counter(rows.n_tokens).items())
    assert rows.bucket_len.sum() == packing.padded(histogram, packing.optimal_boundaries(histogram, 4))
    assert packing.pack(no_docs).count() == 0
