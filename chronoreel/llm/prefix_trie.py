"""The prefix trie of conversations, and what each of its nodes saves if a shared prefix is read once.

A conversation is rebuilt as the first h original turns of its group's first conversation (id less id % GROUP, whose sign is the id's) and its
own turns after its first h; h is the id's crc32 % OWN. A node is a distinct sequence of first turns (role, text); the root has none.

How: turns are numbered in ranges (``ranges``), so a conversation may be as long as the table. A prefix is known by two
running sums of 60-bit hashes of (place, turn), which ranges add up too, without a step from turn to turn. Nodes are
counted by prefix; those with the same members stand in one line below each other and make a chain (same least member, same
number of members), whose sums are differences of running sums. On the tree of chains the leaves are peeled: a chain
holds a counter of children that have not reported; when it is zero, the chain sends its subtree's totals to its parent,
one sum for each parent and round, until only the root is left. So there are as many rounds as shared prefixes that branch
above each other, not as turns. The ids that end in a node are sorted in ranges, packed into texts of at most CHUNK ids, and
stream through SHA-256, which takes them one after the other by its nature; memory does not grow with them.

Defined cases: rows without a conversation id are left out. A null turn number comes first; turns of one number are
ordered by a digest of role and text; repeated rows are turns of their own. Null roles and texts are empty ones. A conversation
rebuilt without turns ends in the root. No conversations: no nodes. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, crc_sql, dropped, fold, stored, text_or_empty, word_count
from chronoreel.llm.ranges import earlier, in_ranges, parts_of, placed, same, spread

#: Conversations of a group, and how many of their first turns may come from its first one (fewer than OWN).
GROUP, OWN = 20, 4
CHUNK = 256

_SUM = "decimal(38,0)"
_SUMS = ("a", "b", "words")


def _turns(conversations: DataFrame) -> DataFrame:
    """Every turn with pos in its conversation (from 0) and the conversation's h, take (turns it gets from its group's first), length (rebuilt)."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(text).alias("words"))
    kept = stored(rows, "turns")
    dealt = in_ranges(kept, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")], "turns-in-order")
    dropped(kept)
    parts = stored(parts_of(dealt, ["conv_id"]), "turn-parts")
    sizes = parts.where(F.col("__before") == 0).select("conv_id", F.col("__total").alias("n"), fold("conv_id", OWN).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first_id"))
    firsts = sizes.select(F.col("conv_id").alias("first_id"), F.col("n").alias("there"))
    sizes = sizes.join(firsts, "first_id", "left").withColumn("take", F.least("h", F.coalesce("there", F.lit(0))))
    sizes = sizes.select("conv_id", "first_id", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return stored(placed(dealt, parts.join(sizes, "conv_id"), ["conv_id"]), "placed-turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, d, a, b, words, sum_a, sum_b, sum_words, length), one for each first d rebuilt turns, and the conversations (conv_id, length)."""
    turns = _turns(conversations)
    convs = turns.where(F.col("pos") == 0).select("conv_id", "first_id", "take", "length")
    heads = turns.where((F.col("conv_id") == F.col("first_id")) & (F.col("pos") < OWN - 1)).select("first_id", "pos", "digest", "words")

    def hashed(rows: DataFrame) -> DataFrame:
        code = F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("digest")).cast("binary"))
        part = lambda at: F.conv(F.substring(code, at, 15), 16, 10).cast(_SUM)
        return rows.withColumns({"a": part(1), "b": part(16)}).drop("digest")

    given = convs.where(F.col("take") > 0).join(heads, "first_id").where(F.col("pos") < F.col("take"))
    given = hashed(given.select("conv_id", (F.col("pos") + 1).alias("d"), "digest", "words", "length"))
    own = turns.where(F.col("pos") >= F.col("h"))
    own = hashed(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("take") + 1).alias("d"), "digest", "words", "length", "__part", "__at"))
    out = ["conv_id", "d", *_SUMS, *[f"sum_{c}" for c in _SUMS], "length"]
    so_far = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)

    first = given.withColumns({f"sum_{c}": F.sum(c).over(so_far("conv_id").orderBy("d")) for c in _SUMS})  # OWN - 1 rows at most
    start = given.groupBy("conv_id").agg(*[F.sum(c).alias(f"start_{c}") for c in _SUMS])
    parts = own.groupBy("__part", "conv_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    before = parts.select("__part", "conv_id", *[earlier(c, ["conv_id"]).alias(f"before_{c}") for c in _SUMS]).join(start, "conv_id", "left")
    before = before.select("__part", "conv_id", *[(F.col(f"before_{c}") + F.coalesce(f"start_{c}", F.lit(0))).cast(_SUM).alias(f"before_{c}") for c in _SUMS])
    rest = same(own, bounded(before, "turn-sums"), ["__part", "conv_id"])
    rest = rest.withColumns({f"sum_{c}": F.sum(c).over(so_far("__part", "conv_id").orderBy("__at")) + F.col(f"before_{c}") for c in _SUMS})
    kinds = {c: "long" if c in ("conv_id", "d", "words", "sum_words", "length") else _SUM for c in out}
    both = first.select(*[F.col(c).cast(kinds[c]).alias(c) for c in out]).unionAll(rest.select(*[F.col(c).cast(kinds[c]).alias(c) for c in out]))
    return stored(both, "prefixes"), stored(convs.select("conv_id", "length"), "conversations")


KEY = ["d", "sum_a", "sum_b"]
PARENT = ["up_d", "up_a", "up_b"]


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes by KEY, with their parent's, members, words of their last turn and of all."""
    found = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.first("sum_words").alias("sum_words"),
        F.first("a").alias("a"), F.first("b").alias("b"),
    )
    zero = F.lit(0).cast(_SUM)
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > 0)
    root = root.select(F.lit(0).cast("long").alias("d"), zero.alias("sum_a"), zero.alias("sum_b"), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("sum_words"), zero.alias("a"), zero.alias("b"))
    ups = {"up_d": F.col("d") - 1, "up_a": (F.col("sum_a") - F.col("a")).cast(_SUM), "up_b": (F.col("sum_b") - F.col("b")).cast(_SUM)}
    return stored(found.unionByName(root).withColumns(ups).drop("a", "b"), "trie-nodes")


def _chains(nodes: DataFrame) -> DataFrame:
    """Nodes with the same members as one row: KEY of the lowest, PARENT of the highest, words read to the lowest and before the highest."""
    place = lambda names: F.struct(*names)
    rows = nodes.groupBy("conv_id", "n_convs").agg(
        F.max_by(place(KEY), "d").alias("low"), F.min_by(place(PARENT), "d").alias("high"), F.min("d").alias("top"), F.max("sum_words").alias("read"), F.min(F.col("sum_words") - F.col("words")).alias("before"),
    )
    rows = rows.select("conv_id", "n_convs", "low.*", "high.*", "top", "read", ((F.col("n_convs") - 1) * (F.col("read") - F.col("before"))).alias("own"))
    rows = stored(rows, "chains")
    children = rows.where(F.col("top") > 0).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)], "n_children")
    return rows.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def peel(chains: DataFrame) -> tuple[DataFrame, int]:
    """``chains`` with below (totals of all children's subtrees) and leaves, and the number of rounds.

    In each round the chains whose children have all reported send one message; the others take up the sums of theirs.
    """
    zero = F.lit(0).cast("long")
    now = stored(chains.withColumns({"waiting": F.col("n_children"), "below": zero, "leaves": (F.col("n_children") == 0).cast("long")}), "peel")
    done, left = None, now.count()
    rounds = 0
    while left:
        ready = now.where(F.col("waiting") == 0)
        done = ready if done is None else done.unionAll(ready)
        rounds += 1
        sent = ready.where(F.col("top") > 0).groupBy(*PARENT).agg(F.sum(F.col("own") + F.col("below")).alias("__below"), F.sum("leaves").alias("__leaves"), F.count(F.lit(1)).alias("__sent"))
        sent = sent.select(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)], "__below", "__leaves", "__sent")
        rest = now.where(F.col("waiting") > 0).join(sent, KEY, "left")
        add = lambda c, m: (F.col(c) + F.coalesce(m, zero)).cast("long")
        after = stored(rest.withColumns({"waiting": add("waiting", F.negative("__sent")), "below": add("below", "__below"), "leaves": add("leaves", "__leaves")}).drop("__below", "__leaves", "__sent"), "peel")
        n = after.count()
        if n >= left:
            raise RuntimeError("no chain is ready: the nodes are not a tree")
        now, left = after, n
    return done if done is not None else now, rounds


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of each node in which conversations end."""
    import hashlib

    zero = F.lit(0).cast(_SUM)
    last = rows.where(F.col("d") == F.col("length")).select(*KEY, "conv_id")
    empty = convs.where(F.col("length") == 0).select(F.lit(0).cast("long").alias("d"), zero.alias("sum_a"), zero.alias("sum_b"), "conv_id")
    dealt = in_ranges(stored(last.unionAll(empty), "ends"), [*map(F.col, KEY), F.col("conv_id")], "ends-in-order")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    packed = dealt.groupBy(*KEY, F.floor(F.col("__at") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    named = packed.select(F.concat_ws(":", *KEY).alias("node"), "chunk", "ids")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for pdf in batches:
            out = []
            for key, ids in zip(pdf["node"], pdf["ids"], strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    found = named.repartition("node").sortWithinPartitions("node", "chunk").mapInPandas(digest, "node string, ends_sha256 string")
    parts = F.split("node", ":")
    return found.select(parts[0].cast("long").alias("d"), parts[1].cast(_SUM).alias("sum_a"), parts[2].cast(_SUM).alias("sum_b"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(conversations)
    nodes = _nodes(rows, convs)
    done, _ = peel(_chains(nodes))
    done = stored(done, "peeled")
    parents = done.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)], F.col("conv_id").alias("parent"), F.col("n_children").alias("__rows"))
    named = spread(done, parents, PARENT, "__rows", done.count(), "parents", "left")
    info = named.select("conv_id", "n_convs", F.col("d").alias("low"), "top", "read", "below", "leaves", "n_children", "parent", (F.col("d") - F.col("top") + 1).alias("__rows"))
    found = spread(nodes, info, ["conv_id", "n_convs"], "__rows", nodes.count(), "chain-figures").join(_ends(rows, convs), KEY, "left")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("read") - F.col("sum_words") + F.col("words"))
    return found.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("d") < F.col("low"), F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: DuckDB form of ``trie``; a prefix is a chain of digests there.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dg,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, dg, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, any_value(conv_id - conv_id % {GROUP}) AS first_id FROM o GROUP BY conv_id),
h AS (SELECT conv_id, first_id, {crc_sql("conv_id")} % {OWN} AS h FROM c),
b AS (SELECT h.conv_id, o.pos AS pos, dg, words, 0 AS part FROM h JOIN o ON o.conv_id = h.first_id AND o.pos <= h.h
  UNION ALL SELECT h.conv_id, o.pos, dg, words, 1 FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(dg, '') OVER w) AS node, words FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
l AS (SELECT h.conv_id, coalesce(max(depth), 0) AS length FROM h LEFT JOIN d USING (conv_id) GROUP BY h.conv_id),
r AS (SELECT conv_id, depth, node, words FROM d UNION ALL SELECT conv_id, 0, 'root', 0 FROM l),
n AS (SELECT depth, node, count(*) AS n_convs, min(r.conv_id) AS conv_id, any_value(words) AS words,
    sha256(coalesce(string_agg(r.conv_id::VARCHAR, ',' ORDER BY r.conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM r JOIN l USING (conv_id) GROUP BY depth, node),
p AS (SELECT n.depth, n.node, u.node AS up FROM n LEFT JOIN r u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
k AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM p WHERE up IS NOT NULL GROUP BY 1, 2),
q AS (SELECT n.*, pn.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM n JOIN p USING (depth, node) LEFT JOIN n pn ON pn.depth = n.depth - 1 AND pn.node = p.up LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
s AS (SELECT a.depth, a.node, sum((q.n_convs - 1) * q.words) AS saved_tokens, count_if(q.n_children = 0) AS n_leaves FROM q JOIN r a ON a.conv_id = q.conv_id AND a.depth <= q.depth GROUP BY a.depth, a.node)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM q JOIN s USING (depth, node)"""
