import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoreel.llm import line_dedup

ENDS = " \t\n\x0b\x0c\r"
A, B, C = "A line that many documents share.", "Another line, found in three of them", "Only two documents have this line"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = defaultdict(list)
    for r, (doc_id, text) in enumerate(rows):
        for key in {x.strip(ENDS).translate(LOWER) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                holders[key].append((r, doc_id))
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            have = holders.get(line.strip(ENDS).translate(LOWER), [])
            top = max((d for _, d in have if d is not None), default=None)
            if len(have) < 3 or doc_id == top:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rows = [(i, f"Own line of document number {i}\n{A}\n\nshort\n {A.upper()}\r\n{B if i % 20 == 3 else ''}\n{C if i in (5, 6) else 'x'}") for i in range(60)]
    rows += [(100, A), (101, f"{A}\n{B}\n{A}"), (None, f"{A}\nnull id"), (None, None), (102, ""), (103, "\n\n"), (3, f"{B}\nsame id, other text"), rows[4], rows[4]]
    # Null ids alone, repeated rows of the largest id, letters that only Unicode folds, exactly twenty code points.
    rows += [(None, "Held by rows without an id")] * 3 + [(500, "Held by the largest id's rows")] * 3 + [(7 + i, "ÄÖÜ groß ist nicht ä" if i else "äöü groß ist nicht ä") for i in range(3)]
    rows += [(200 + i, "x" * 20 + "\n" + "y" * 19) for i in range(3)]
    rows += [(300, "\n".join(f"line {i % 700} of a very long document" for i in range(30_000)))] + [(301 + i, "line 5 of a very long document") for i in range(2)]
    return rows


@pytest.mark.parametrize("batches,fanout,small", [(6, 3, 8 << 20), (1, 2, 0), (5, 2, 0)])
def test_lines_equal_brute_force(spark, monkeypatch, batches, fanout, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in line_dedup.measure(docs, batches=batches, fanout=fanout).collect()), key=str) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_sql_empty_tables_and_clashing_names(spark, odd_docs, no_docs):
    rows = texts()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(line_dedup.ORACLE).fetchall(), key=str) == brute(rows)
    assert line_dedup.measure(no_docs).count() == 0
    out = line_dedup.clean(odd_docs.withColumns({"h": F.lit(1), "places": F.lit(2), "digest": F.lit("d"), "n_lines": F.lit("clash")}))
    assert out.count() == odd_docs.count() and out.select("h", "places", "digest", "size").distinct().count() == 1
    assert out.where("doc_id = 100").first()["text"] is None


def test_runs_settle_and_are_compacted(spark):
    """Batches in any order give one result; what is settled is not written again, and runs are merged by level."""
    def hashes(ids, keys):
        return spark.createDataFrame([(i, keys) for i in ids], "doc_id long, hashes array<string>")

    parts = [hashes(range(90, 100), ["a", "b", None, "a"]), hashes(range(40, 50), ["a", "c"]), hashes(range(10), ["a", "b"]), hashes([200], ["a"])]
    runs = line_dedup.LineRuns(spark, fanout=3)
    for part in parts:
        runs.add(part)
    # The first batch settles a and b, so the next two add c alone and nothing; the id of the last is larger, so it counts.
    assert [n for where, n in runs.log if where == "level 0"] == [2, 1, 0, 1]
    assert [len(x) for x in runs.levels] == [1, 1]
    want = {("a", 200), ("b", 99), ("c", 49)}
    assert {tuple(r) for r in runs.common().collect()} == want
    back = line_dedup.LineRuns(spark, buckets=3, fanout=2)
    for part in reversed(parts):
        back.add(part)
    assert {tuple(r) for r in back.common().collect()} == want
    plan = runs.unsettled(hashes([1], ["a"]).select("doc_id", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange") <= 2 and "Python" not in text
    merge = runs._merged([x for level in runs.levels for x in level])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merge and "Exchange" not in merge
    runs.drop()
    back.drop()
