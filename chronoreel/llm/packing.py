"""Packing by optimal length buckets.

A histogram of lengths over all documents feeds a dynamic program that picks the bucket boundaries
with the least padding; batches under a token budget then form inside each bucket. Lengths count
words, and the histogram keeps each on its own. It is counted by the cluster and only then sent to the
driver: documents of n words in all have at most sqrt(2 n) different lengths, since these add up to no
more than n; 10^13 words have 4.5 million at most. A boundary is always a length that occurs.

A batch of a bucket has max(1, budget // boundary) rows, so a document longer than the budget fills a
batch alone. Rows of a bucket are ordered by shard and hash; they are numbered in ranges of that order, with
one row for each range and bucket that says how many are before: no bucket is gathered in one task, and
equal rows are dealt over ranges too.

Defined cases: a null text has length 0; empty documents go to the shortest bucket; ties of the order
(a hash of id and text) fall back on the id; repeated rows each get a place; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import stored, text_or_empty, word_count
from chronoreel.llm.ranges import in_ranges, parts_of
from chronoreel.llm.ranges import placed as in_places

BUCKETS = 16
BUDGET = 65_536
SHARD_ROWS, MOST_SHARDS = 1024, 65_536
SCALE, PLACE = 1 << 40, 2_654_435_761  # padded tokens count first, then numbers that stand for places


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the largest length) that minimise padded tokens.

    Of boundaries with as many, a fixed number of each boundary's place decides, so that all ways to compute them agree.
    ``histogram``: (length, count), ascending. With C the count up to a length, a layer of the program is
    best[j] = min over i of last[i] + length[j] * (C[j] - C[i]): lines in length[j], so each layer is one
    pass over a lower envelope, all in whole numbers.
    """
    if not histogram:
        return []
    lengths = [x for x, _ in histogram]
    counts = [0]
    for _, c in histogram:
        counts.append(counts[-1] + c)
    n, layers = len(lengths), min(buckets, len(lengths))
    cost: list[int | None] = [0] + [None] * n
    parents: list[array] = []
    for _ in range(layers):
        fresh: list[int | None] = [None] * (n + 1)
        parent = array("l", bytes((n + 1) * array("l").itemsize))
        hull: list[tuple[int, int, int]] = []  # slope -C[i], value, i; slopes fall from left to right
        at = 0
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                slope, value = -counts[j - 1] * SCALE, cost[j - 1]
                while len(hull) - at >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (value - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, value, j - 1))
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if at < len(hull):
                fresh[j] = hull[at][0] * x + hull[at][1] + x * counts[j] * SCALE + j * PLACE % (1 << 32)
                parent[j] = hull[at][2]
        parents.append(parent)
        cost = fresh
    cuts, j = [], n
    for parent in reversed(parents):
        cuts.append(lengths[j - 1])
        j = parent[j]
        if j == 0:
            break
    return cuts[::-1]


def padded(histogram: list[tuple[int, int]], boundaries: list[int]) -> int:
    """Tokens after padding each length to its boundary."""
    return sum(c * boundaries[bisect.bisect_left(boundaries, x)] for x, c in histogram)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket_id, bucket_len, batch_no, slot, padding."""
    text = F.md5(text_or_empty(text_col).cast("binary"))
    order = F.md5(F.concat(F.lit("pack:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    base = stored(docs.select(F.col(id_col).alias("doc_id"), word_count(text_or_empty(text_col)).alias("n_tokens"), order.alias("order")), "pack-lengths")
    found = base.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).orderBy("n_tokens").toArrow()
    histogram = list(zip(found.column("n_tokens").to_pylist(), found.column("c").to_pylist(), strict=True))
    boundaries = optimal_boundaries(histogram, buckets) or [0]
    shards = min(MOST_SHARDS, max(1, -(-sum(c for _, c in histogram) // SHARD_ROWS)))
    bucket = F.lit(0)
    for b in boundaries[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    placed = (
        base.withColumn("bucket_id", bucket)
        .withColumn("bucket_len", F.element_at(F.array(*[F.lit(b).cast("long") for b in boundaries]), F.col("bucket_id") + 1))
        .withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % shards)
    )
    # Ranges hold rows that agree in all of the order too, however many there are.
    dealt = in_ranges(placed, [F.col("bucket_id"), F.col("shard"), F.col("order"), F.col("doc_id").asc_nulls_first(), F.col("n_tokens")], "pack-order")
    ranked = in_places(dealt, parts_of(dealt, ["bucket_id"]), ["bucket_id"])
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    place = F.col("pos")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket_id",
        "bucket_len",
        F.floor(place / rows).alias("batch_no"),
        (place % rows).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


#: DuckDB form of ``pack`` with the production parameters; the program's layers are steps of the recursion.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
    md5('pack:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
h AS (SELECT n_tokens AS len, row_number() OVER (ORDER BY n_tokens) AS j, sum(count(*)) OVER (ORDER BY n_tokens) AS cum FROM d GROUP BY n_tokens),
p AS (
  SELECT 0 AS layer, 0::BIGINT AS j, 0::HUGEINT AS cum, 0::HUGEINT AS cost, []::BIGINT[] AS cuts
  UNION ALL
  SELECT layer + 1, j, cum, cost, cuts FROM (
    SELECT p.layer, h.j, h.cum::HUGEINT AS cum,
      min(p.cost + h.len::HUGEINT * (h.cum - p.cum) * {SCALE}::HUGEINT + (h.j * {PLACE}) % {1 << 32}) AS cost,
      arg_min(list_append(p.cuts, h.len), p.cost + h.len::HUGEINT * (h.cum - p.cum) * {SCALE}::HUGEINT + (h.j * {PLACE}) % {1 << 32}) AS cuts
    FROM p JOIN h ON h.j > p.j WHERE p.layer < {BUCKETS} GROUP BY p.layer, h.j, h.len, h.cum)),
b AS (SELECT cuts FROM p WHERE j = (SELECT max(j) FROM h) AND layer = least({BUCKETS}, (SELECT max(j) FROM h))),
s AS (SELECT greatest(1, least({MOST_SHARDS}, (count(*) + {SHARD_ROWS - 1}) // {SHARD_ROWS})) AS shards FROM d),
g AS (SELECT d.*, ('0x' || substr(ord, 1, 8))::BIGINT % s.shards AS shard, len(list_filter(b.cuts[:-2], lambda x: d.n_tokens > x))::INT AS bucket_id, b.cuts FROM d, b, s),
r AS (SELECT *, cuts[bucket_id + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket_id ORDER BY shard, ord, doc_id, n_tokens) - 1 AS place FROM g)
SELECT doc_id, n_tokens, bucket_id, bucket_len, (place // greatest(1, {BUDGET} // greatest(bucket_len, 1)))::BIGINT AS batch_no,
  (place % greatest(1, {BUDGET} // greatest(bucket_len, 1)))::INT AS slot, bucket_len - n_tokens AS padding
FROM r
"""
