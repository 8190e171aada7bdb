import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoreel.llm import components, simhash, vectors


def closed(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 200
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)], "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 150)], "none": []}[shape]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = closed(n, edges)
    assert got == {i: want[i] for e in edges for i in e if e[0] != e[1]}
    a, b = (np.array([e[k] for e in edges], int) for k in (0, 1))
    assert components.local_labels(n, a, b).tolist() == want


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("heavy", [1, 65_536])
def test_simhash_equals_brute_force(spark, odd_docs, no_docs, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "MOST_HEAVY", heavy)
    monkeypatch.setattr(simhash, "RANGE_ROWS", 8)
    docs = odd_docs.where(F.col("doc_id").isNotNull())
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = closed(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2])
    ids = [min(rows[j][0] for j in range(len(rows)) if want[j] == want[i]) for i in range(len(rows))]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(docs).collect())
    assert got == sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, ids, strict=True))
    assert simhash.groups(odd_docs).count() == odd_docs.count() and simhash.groups(no_docs).count() == 0


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    chosen = {r["component_id"] for r in simhash.groups(odd_docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in chosen if c is not None)
    assert ids.count(None) == 2 and simhash.keep_one(no_docs).count() == 0


def test_gray_rank_is_the_inverse_of_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def near_codes(rng, n, flips):
    base = rng.integers(0, 2**63, 20).astype(np.uint64)
    codes = base[rng.integers(0, 20, n)]
    for _ in range(flips):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.3).astype(np.uint64)
    return np.unique(codes)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_gray_tree_finds_all_pairs(radius):
    codes = near_codes(np.random.default_rng(radius), 500, 6)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    tree = simhash.GrayTree(codes)
    got = {(i, j) for a, b in tree.search(codes, radius, at_once=64) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= radius}
    assert tree.pruned > len(codes)


def test_gray_tree_of_patterns_leaves_only_far_ranges():
    rng = np.random.default_rng(3)
    codes = near_codes(rng, 800, 8)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    parts = np.array_split(codes, 40)
    all_, any_ = (np.array([f.reduce(p) for p in parts]) for f in (np.bitwise_and, np.bitwise_or))
    got = {(i, j) for a, b in simhash.GrayTree(all_, all_ ^ any_).search(codes, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, c in enumerate(codes) for j, p in enumerate(parts) if (np.bitwise_count(p ^ c) <= 2).any()}
    assert want <= got and len(got) < 0.6 * len(codes) * len(parts)


@pytest.mark.parametrize("range_rows", [4, 16, 1000])
def test_ranges_lose_no_pair(spark, range_rows):
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([[0], 1 << rng.integers(0, 20, 10), (1 << rng.integers(0, 20, 200)) | (1 << rng.integers(0, 20, 200)) | (1 << rng.integers(0, 20, 200)), rng.integers(0, 2**62, 50)])).astype(np.int64)
    codes = np.unique(np.r_[codes, -codes])
    df = spark.createDataFrame([(int(c),) for c in codes], "fp long")
    edges = simhash.near_edges(df, 2, range_rows=range_rows)
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    near = lambda i, j: ((int(codes[i]) ^ int(codes[j])) & (2**64 - 1)).bit_count() <= 2
    want = closed(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if near(i, j)])
    assert all(got.get(int(c), int(c)) == int(codes[w]) for c, w in zip(codes, want, strict=True))


def test_whole_groups_are_pruned(spark, caplog):
    codes = np.unique(np.random.default_rng(4).integers(-(2**63), 2**63, 3000))
    with caplog.at_level("INFO", logger="chronoreel.llm.simhash"):
        assert simhash.near_edges(spark.createDataFrame([(int(c),) for c in codes], "fp long"), range_rows=200).count() == 0
    assert int(caplog.messages[-1].split(", ")[1].split()[0]) > 10 * len(codes)


def crowd(rng, n, d=16):
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[0] + 0.12 * rng.normal(size=(n - n // 2, d))
    x[10] = x[11] = x[12]
    x[13] = 3 * x[14]
    return x.astype(np.float32)


def plain_links(x):
    u = vectors.unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near.sum(axis=1), closed(len(x), list(zip(*np.nonzero(np.triu(near)), strict=True)))


@pytest.mark.parametrize("probes", [0, vectors.PROBES])
def test_vectors_equal_brute_force(spark, monkeypatch, probes):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "VISITORS", 50)
    x = crowd(np.random.default_rng(1), 600)
    odd = [(None, None), (1001, None), (1002, []), (1003, [0.0] * 16), (1004, [float("nan")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [float("inf")] + [1.0] * 15), (1007, [1.0] * 3), (1008, [1.0] * 3)]
    rows = [(i, v, "clash", "clash") for i, v in [*((i, [float(t) for t in r]) for i, r in enumerate(x)), *odd]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, v string").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.links(df, probes=probes).collect()}
    n, labels = plain_links(x)
    assert all(got[i] == (n[i], labels[i], labels[i] == i) for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in (None, *range(1001, 1007))) and got[1007] == (1, 1007, True) and got[1008] == (1, 1007, False)
    assert vectors.links(df.limit(0)).count() == 0


def test_vectors_equal_their_sql(spark):
    import duckdb

    x = crowd(np.random.default_rng(6), 200)
    df = spark.createDataFrame([*((i, [float(t) for t in r]) for i, r in enumerate(x)), (900, None), (901, [0.0] * 16)], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("t", df.toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM t")
    want = con.execute(vectors.ORACLE).df().sort_values("vec_id")
    got = vectors.links(df).toPandas().sort_values("vec_id")
    assert got.to_numpy().tolist() == want[got.columns].to_numpy().tolist()


def test_cells_of_top_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 12))
    x[1500:] = 0.97 * x[:1500] + 0.1 * rng.normal(size=(1500, 12))
    df = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors._centroids, "__defaults__", (4,))  # two levels from five cells on
    n, _ = plain_links(x)
    got = {r["vec_id"]: r["n_links"] for r in vectors.links(df).collect()}
    assert all(got[i] <= n[i] for i in range(len(x))) and sum(got.values()) >= 0.99 * n.sum()


def test_cells_left_out_hold_nothing_linked():
    rng = np.random.default_rng(11)
    middle = vectors.unit(rng.normal(size=(12, 16)))
    x = vectors.unit(middle[rng.integers(0, 12, 1500)] + 0.15 * rng.normal(size=(1500, 16)))
    centroids = vectors.spherical_kmeans(x, 30)
    home, near = vectors.nearest_cells(x, centroids, 0, 0.9)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert (near[i] == home[j][:, None]).any(axis=1).all()
    assert (near >= 0).sum() < 0.7 * near.size


@pytest.mark.parametrize("rows", [2000, 20_000, 100_000])
def test_recall_without_clusters(rows):
    rng = np.random.default_rng(rows)
    x = vectors.unit(rng.normal(size=(rows // 2, 64)))
    e = rng.normal(size=x.shape)
    e = vectors.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    y = 0.905 * x + (1 - 0.905**2) ** 0.5 * e
    both = np.concatenate([x, y])
    centroids = vectors.spherical_kmeans(both[rng.choice(rows, min(rows, 16_384), replace=False)], round(rows**0.5 / 2))
    (home_x, near_x), (home_y, near_y) = (vectors.nearest_cells(z, centroids, vectors.PROBES, 0.9) for z in (x, y))
    found = (near_x == home_y[:, None]).any(axis=1) | (near_y == home_x[:, None]).any(axis=1)
    assert found.mean() >= 0.99


def test_repeated_rows_link_with_each_other(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [1.0, 0.1]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.links(df).collect())
    assert got == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 0, 9)]
