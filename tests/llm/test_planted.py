"""The registered queries against their SQL on tables with planted copies, links, nulls and repeated payloads, which the given tables lack."""

import random

import duckdb
import numpy as np
import pytest

from chronoreel.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("planted")
    rng, draw = random.Random(8), np.random.default_rng(8)

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{root}/{name}.parquet")

    words = [f"word{i}" for i in range(400)]
    line = "This line stands in very many of the documents here."
    docs = []
    for i in range(160):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6)))
        docs.append((i, text + (f"\n{line}\nkey {i % 3} of a repeated line, longer than twenty" if i % 2 else ""), rng.choice(["en", "de", None]), f"src{i % 5}" if i % 11 else None, len(text)))
    docs += [(200 + i, docs[7][1], "en", "src1", docs[7][4]) for i in range(40)]
    docs += [(300, None, None, None, None), (301, "", "en", "src0", 0), (302, "x " * 3000, "en", "src0", 6000), (303, "\n\n\n", "en", "ünder", 3)]
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    base = draw.normal(size=(60, 16))
    near = base[:20] + 0.05 * draw.normal(size=(20, 16))
    vectors = [[float(x) for x in v] for v in np.concatenate([base, near, base[:5], np.zeros((1, 16))])]
    vectors += [None, [float("nan")] * 16]
    write("embeddings", [(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    pages = [(i, f"http://h{i % 4}.example/{i}", f"<html><body><article><p>{' '.join(rng.choices(words, k=300))}</p></article></body></html>") for i in range(30)]
    pages += [(100 + i, "u", pages[3][2]) for i in range(9)] + [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (204, None, pages[5][2])]
    write("pages", pages, "page_id long, url string, html string")
    turns = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hello there", "fine, thanks", None, "go on with it"])) for c in range(90) for t in range(rng.randint(1, 5))]
    turns += [(1000 + i, t, "user", f"the same turn {t}") for i in range(20) for t in range(4)] + [(2000, None, None, "no number")]
    write("conversations", turns, "conv_id long, turn long, role string, text string")
    return str(root)


def rows(pdf):
    def plain(x):
        if x is None or str(x) in ("<NA>", "nan"):
            return "~"
        return str(round(x, 4)) if isinstance(x, (float, np.floating)) and x != int(x) else str(int(x)) if isinstance(x, (float, np.floating)) else str(x)

    names = sorted(pdf.columns)
    return names, sorted(tuple(plain(x) for x in row) for row in pdf[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = rows(QUERIES[name](spark, folder).toPandas()), rows(con.execute(ORACLES[name]).df())
    assert got == want and len(got[1]) > 30
    shown = {n: {r[k] for r in got[1]} for k, n in enumerate(got[0])}
    if name == "op1_vector_links":
        assert len(shown["n_links"]) > 2 and shown["kept"] == {"True", "False"}
    if name == "op3_warc_revisits":
        assert shown["record_type"] == {"response", "revisit"}
    if name == "op11_merkle_manifest":
        assert shown["verified"] == {"True", "False"}
    if name == "op12_line_dedup":
        assert len(shown["n_dropped"]) > 2
    if name == "op13_prefix_trie":
        assert len(shown["n_convs"]) > 5
