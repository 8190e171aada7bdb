import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoreel.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, paths):
    """One tree: nodes are lists of the leaves below them; each leaf's path gets (left, right) level by level."""
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for run in runs:
            for k, (_, below) in enumerate(run):
                for x in below:
                    paths[x].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
        nodes = [(H(*[h for h, _ in run]), [x for _, below in run for x in below]) for run in runs]
    return nodes[0]


def brute(rows):
    paths, tops, sub = {i: [] for i in range(len(rows))}, [], {}
    leaves = [leaf_of(r, r["text"]) for r in rows]
    for source in sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((i for i, r in enumerate(rows) if r["source"] == source), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaves[i]))
        top = climb([(leaves[i], [i]) for i in own], paths)
        tops.append(top)
        sub |= dict.fromkeys(own, top[0])
    root = climb(tops, paths)[0]
    out = []
    for i, r in enumerate(rows):
        text = r["text"]
        if text is not None and zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        now = leaf_of(r, text)
        for left, right in paths[i]:
            now = H(left, now, right)
        out.append((r["doc_id"], leaves[i], sub[i], root, H(*[x for pair in paths[i] for x in pair]), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels,ranges,buckets", [(7, 5000, 20_000), (1, 7, 5), (2, 9, 30)])
def test_manifest_equals_brute_force(spark, odd_docs, monkeypatch, levels, ranges, buckets):
    from chronoreel.llm import ranges as module

    monkeypatch.setattr(module, "LEAST_ROWS", ranges)
    monkeypatch.setattr(module, "MOST_ROWS", 10 * ranges)
    monkeypatch.setattr(merkle, "BUCKET_ROWS", buckets)
    more = spark.range(200, 290).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a\n\nb"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 270, F.lit("hot")).otherwise(F.concat(F.lit("ü"), F.col("id").cast("string"))).alias("source"), F.lit(7).cast("long").alias("n_chars"),
    )
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    got = [tuple(r) for r in merkle.manifest(docs, levels, merkle.tampered_lines()).select(*COLUMNS).collect()]
    want = brute([r.asDict() for r in docs.collect()])
    assert sorted(got, key=str) == want
    assert {x[-1] for x in got} == {True, False}


def test_manifest_sql_and_lone_rows(spark, odd_docs, no_docs):
    con = duckdb.connect()
    con.register("documents", odd_docs.toPandas())
    names = ("doc_id", "source", *COLUMNS[1:])
    plain = odd_docs.where(F.col("doc_id").isNotNull())
    con.register("documents", plain.toPandas().astype({"doc_id": "int64"}).astype({"n_chars": "Int64"}))
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({merkle.ORACLE})").fetchall(), key=str)
    got = sorted((tuple(r) for r in merkle.manifest(plain, tampered=merkle.tampered_lines()).select(*names).collect()), key=str)
    assert got == want
    assert merkle.manifest(no_docs).count() == 0
    lone = merkle.manifest(odd_docs.where("doc_id = 3")).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] and lone["verified"]
    assert lone["proof_sha256"] == H("")


def test_equal_rows_and_a_hot_source(spark, monkeypatch):
    """Rows that agree in all columns, and a source with all rows, are dealt over many ranges."""
    from chronoreel.llm import ranges as module

    monkeypatch.setattr(module, "LEAST_ROWS", 50)
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("x").alias("text"))
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 100)
    found = merkle.manifest(docs, 2)
    assert found.where("verified").count() == 600 and found.select("proof_sha256").distinct().count() > 1
    dealt = module.in_ranges(merkle.stored(docs, "t"), [F.col("source"), F.col("doc_id")], "t")
    assert dealt.groupBy("__part").count().agg(F.max("count")).first()[0] < 400
