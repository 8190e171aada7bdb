"""Very many rows that agree: equal rows in packing, one passage in all texts, ids that are all null."""

import random
from collections import Counter

from pyspark.sql import functions as F

from chronoreel.llm import near_copies, packing, ranges, secrets
from chronoreel.llm.common import stored


def test_equal_rows_get_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_ROWS", 100)
    docs = spark.range(2500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text")).unionAll(spark.createDataFrame([(7, "a b"), (None, None)], "doc_id long, text string"))
    rows = packing.pack(docs, budget=30).collect()
    places = Counter((r["bucket_id"], r["batch_no"], r["slot"]) for r in rows)
    assert len(rows) == 2502 and max(places.values()) == 1
    full = [r for r in rows if r["n_tokens"] == 3]
    assert {r["batch_no"] for r in full} == set(range(250)) and {r["slot"] for r in full} == set(range(10))
    base = stored(docs.select("doc_id", F.lit(0).alias("bucket_id")), "t")
    dealt = ranges.in_ranges(base, [F.col("bucket_id"), F.col("doc_id")], "t")
    assert dealt.groupBy("__part").count().agg(F.max("count")).first()[0] < 2000


def texts(rng, n, common):
    return [" ".join([*(f"w{rng.randrange(100_000)}" for _ in range(40)), *common, *(f"v{rng.randrange(100_000)}" for _ in range(20))]) for _ in range(n)]


def test_one_passage_in_all_texts_makes_no_crowded_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 64)
    rng = random.Random(3)
    common = [f"licence{i}" for i in range(60)]  # 56 shingles that all texts share, some of them among the lowest of each
    rows = texts(rng, 3000, common)
    edited = rows[5].split()
    edited[3] = "edited"
    rows += [" ".join(edited), rows[9].replace("w", "W")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = stored(near_copies.prints(docs).groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "digest", "n", "a", "b", "lowest")]), "nodes")
    before = near_copies._tasks(nodes.withColumn("lowest", F.slice("lowest", 1, near_copies.LOWEST)).select("key", "n", "a", "b", "lowest"), 64).count()
    after = near_copies._tasks(near_copies._routes(nodes).select("key", "n", "a", "b", "lowest"), 64).count()
    assert before > 40 * len(rows) and after < 4 * len(rows)
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert kept == set(range(3000))


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85 against all comparisons, with a passage that all share."""
    rng = random.Random(11)
    common = [f"licence{i}" for i in range(12)]
    rows = texts(rng, 150, common)
    for base in list(rows):
        words = base.split()
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) <= 0.87]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    found = sum(i not in kept for i, _ in near)
    assert len(near) > 60 and found >= 0.95 * len(near)


def test_samples_without_ids_are_drawn_by_text(spark):
    rng = random.Random(2)
    words = ["river", "stone", "light", "garden", "winter"]
    docs = spark.createDataFrame([(None, " ".join(rng.choices(words, k=20)) + f" n{i}") for i in range(4000)], "doc_id long, text string")
    seen = secrets.samples(docs, max_rows=400).where("NOT random AND length(pair) = 1").agg(F.sum("n")).first()[0]
    assert 0.5 * 400 * 20 < seen < 1.6 * 400 * 20
    assert secrets.samples(docs.limit(0)).count() == 0


def test_near_copies_meet_in_the_gray_order_index(spark):
    """Pairs of similarity 0.8 to 0.87 meet by their codes alone, and the index leaves nearly all other texts out."""
    rng = random.Random(21)
    rows = texts(rng, 1200, [])
    for base in rows[:200]:
        words = base.split()
        words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = stored(near_copies.prints(docs).drop("lowest"), "nodes")  # no smallest shingles to meet by
    placed = near_copies._cells(nodes, near_copies.CELL).toArrow().sort_by("task")
    pruned, found = [], set()
    ids = {r["key"]: r["doc_id"] for r in nodes.collect()}
    key = placed.column("key").to_pylist()
    for p, q in near_copies._index_pairs(placed, pruned):
        found |= {tuple(sorted((ids[key[i]], ids[key[j]]))) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    want = {(i, 1200 + i) for i in range(200)}
    assert len(found & want) >= 0.99 * len(want) and not found - want
    assert pruned[0] > placed.num_rows


def test_a_crowded_cell_is_dealt_in_blocks_and_loses_no_pair(spark):
    rng = random.Random(4)
    rows = [" ".join([*(f"w{i}" for i in range(100)), f"v{k}"]) for k in range(40)] + texts(rng, 40, [])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = stored(near_copies.prints(docs), "nodes")
    pairs = []
    for block in (near_copies.CELL, 8):
        placed = near_copies._cells(nodes, block).toArrow().sort_by("task")
        key = placed.column("key").to_pylist()
        pairs.append({frozenset((key[i], key[j])) for p, q in near_copies._index_pairs(placed) for i, j in zip(p.tolist(), q.tolist(), strict=True)})
    assert pairs[0] == pairs[1] and len(pairs[0]) == 40 * 39 // 2
