import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from chronoreel.llm import prefix_trie, ranges
from chronoreel.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, d string, node string, length string, n_convs string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([x for x in text.split(" ") if x])


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in members if n[:-1] == node and n]
        leaves = [n for n in below if not any(m[:-1] == n and m for m in members)]
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == node)))
        saved = sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(3)
    texts = ["hello  there", "how are you", "", None, "fine\tthanks", "bye", "größe"]
    rows = []
    for c in [*range(60), 100, 107, 119, 221, 222, 340, -20, -7]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for t in range(rng.randint(1, 7))]
    # Copies of one conversation, one that goes on where others end, a long one, null turns, ties and repeated rows, no id.
    same = [("user", "a common start"), ("bot", "a common reply"), ("user", "and the end")]
    rows += [(1000 + 20 * i, t, *x) for i in range(30) for t, x in enumerate(same)]
    rows += [(2000, t, *x) for t, x in enumerate(same * 3)] + [(2020, t, *x) for t, x in enumerate(same * 2)] + [(2040, t, "user", f"turn {t}") for t in range(300)]
    rows += [(2060, None, "bot", "first"), (2060, 0, "bot", "second"), (2060, 0, "bot", "other"), (2060, 0, "bot", "other"), (2060, None, None, None)]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("size,share,chunk", [(5000, 10_000, 256), (20, 30, 4)])
def test_trie_equals_brute_force(spark, monkeypatch, size, share, chunk):
    monkeypatch.setattr(ranges, "LEAST_ROWS", size)
    monkeypatch.setattr(ranges, "MOST_ROWS", 10 * size)
    monkeypatch.setattr(ranges, "SHARE", share)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == brute(rows)


def test_sql_and_empty_table(spark):
    rows = conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(prefix_trie.ORACLE).fetchall(), key=str) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", *"abcd")], SCHEMA)).count() == 0


def test_conversation_without_turns_left(spark):
    """An id whose few own turns are replaced by those of a first conversation that is not there."""
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone")]
    found = [tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)).collect()]
    assert found == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_rounds_follow_branches_not_turns(spark):
    """A conversation of 2,000 turns, twice, is one chain; each that ends on another's way is one more round."""
    def rounds(rows):
        df = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)
        prefixes, convs = prefix_trie.rebuilt(df)
        return prefix_trie.peel(prefix_trie._chains(prefix_trie._nodes(prefixes, convs)))

    long = [(c, t, "user", f"turn {t}") for c in (0, 20) for t in range(2000)]
    done, n = rounds(long)
    assert n == 1 and done.count() == 1
    done, n = rounds(long + [(40, t, "user", f"turn {t}") for t in range(900)] + [(60, 0, "user", "else")])
    assert n == 3 and done.count() == 4


def test_spread_keeps_rows_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SHARE", 4)
    many = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 50), (None, 51), ("lost", 52)], "k string, v long")
    one = spark.createDataFrame([("hot", 1.0, 50), ("cold", 2.0, 1)], "k string, x double, size long")
    left = {tuple(r) for r in ranges.spread(many, one, ["k"], "size", 53, "t", "left").select("v", "x").collect()}
    assert left == {(i, 1.0) for i in range(50)} | {(50, 2.0), (51, None), (52, None)}
    assert ranges.spread(many, one, ["k"], "size", 53, "t").count() == 51
    assert stored(one, "t").count() == 2
