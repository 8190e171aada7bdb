"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of the XXH64 values of a text's word shingles have it.
Equal fingerprints are merged first. The distinct ones are sorted by Gray rank and cut into ranges of equal
size. A range's node keeps the bits that all its codes share; upper nodes factor what FANOUT neighbours
share, up to one root. That directory has at most MOST_RANGES ranges and goes to all workers: each
code descends it, adding up its differences from the shared bits, leaves a node as soon as they exceed the
radius, and so reaches the ranges that can hold a code near it, in packets by range. Inside a range the same tree goes on down to
single codes. All pairs are found, since a node is left only when every code below it is too far away.

Codes are distinct, so no range is crowded by copies; the codes that visit a range stream past it. Labels go
back to the texts by fingerprint: those of a fingerprint with many copies are broadcast (of n rows at most
MOST_HEAVY fingerprints can have n / MOST_HEAVY copies), so no fingerprint is one key of a shuffle.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link with each
other and with any code near zero; null ids never become a component's id unless it has no other; repeated
rows are separate rows of one component; an empty table gives no rows; other columns are ignored.
``keep_one`` keeps all rows without an id and, of rows that share an id, one.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import dropped, stored, text_or_empty
from chronoreel.llm.components import connected_components, local_labels

SHINGLE = 3
SEED = 42
RADIUS = 2
FANOUT = 4
RANGE_ROWS = 65_536  # codes of a range, or more where there would be more than MOST_RANGES
MOST_RANGES = 65_536
MOST_HEAVY = 65_536

log = logging.getLogger(__name__)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of UTF-8 text; ASCII lower-casing and ASCII white space are what bytes methods do."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Nodes over codes in Gray order. A leaf is a code, or a pattern: ``vary`` marks the bits it leaves open."""

    def __init__(self, first: np.ndarray, vary: np.ndarray | None = None):
        vary = np.zeros(len(first), np.uint64) if vary is None else vary
        # Each level: a code below each node, the bits in which the codes below it vary, where its children begin.
        self.levels = [(first, vary, np.empty(0, np.int64))]
        self.pruned = 0
        while len(first) > 1:
            starts = np.arange(0, len(first), FANOUT)
            parent = np.arange(len(first)) // FANOUT
            vary = np.bitwise_or.reduceat(vary | (first ^ first[starts][parent]), starts)
            kids = np.r_[starts, len(first)]
            first = first[starts]
            self.levels.append((first, vary, kids))

    def search(self, codes: np.ndarray, radius: int, at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) wherever a code differs from a leaf's fixed bits in at most ``radius``.

        ``pruned`` counts the nodes above the leaves that a query left with all that is below them.
        """
        for begin in range(0, len(codes), at_once):
            part = codes[begin : begin + at_once]
            first, vary, _ = self.levels[-1]
            query, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            gap = np.bitwise_count((part ^ first[0]) & ~vary[0]).astype(np.int8)
            for depth in range(len(self.levels) - 1, 0, -1):
                near = np.flatnonzero(gap <= radius)
                self.pruned += len(gap) - len(near)
                query, node, gap = query[near], node[near], gap[near]
                _, above, kids = self.levels[depth]
                first, vary, _ = self.levels[depth - 1]
                count = kids[node + 1] - kids[node]
                at = np.repeat(np.arange(len(node)), count)
                child = np.arange(len(at)) - np.repeat(np.cumsum(count) - count - kids[node], count)
                own = above[node][at] & ~vary[child]
                gap = gap[at] + np.bitwise_count((part[query][at] ^ first[child]) & own).astype(np.int8)
                query, node = query[at], child
            near = gap <= radius
            yield begin + query[near], node[near]


def _range_edges(members: np.ndarray, visitors: Iterator[np.ndarray], radius: int, pruned) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked among ``members`` and between them and the codes that stream past."""
    members = members[np.argsort(gray_rank(members))]
    tree, labels = GrayTree(members), np.arange(len(members))
    for a, b in tree.search(members, radius):
        labels = local_labels(len(members), np.r_[np.arange(len(members)), a], np.r_[labels, b])
    for codes in visitors:
        for a, b in tree.search(codes, radius):
            here, a = np.unique(a, return_inverse=True)
            n = len(members)
            both = local_labels(n + len(here), np.r_[np.arange(n), n + a], np.r_[labels, b])
            labels = both[:n]
            yield codes[here], members[both[n:]]
    linked = np.flatnonzero(labels != np.arange(len(members)))
    yield members[linked], members[labels[linked]]
    pruned.add(tree.pruned)


def near_edges(codes: DataFrame, radius: int = RADIUS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(src, dst) edges that connect exactly the distinct fingerprints (fp) within ``radius`` bits; stored."""
    spark = codes.sparkSession
    schema = "src long, dst long"
    n = codes.count()
    if not n:
        return spark.createDataFrame([], schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = gray_rank(batch.column(0).to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)  # so that signed order is its order
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place.view(np.int64))], ["fp", "rank"])

    ranges = -(-n // max(range_rows, -(-n // MOST_RANGES)))
    ranked = codes.select("fp").mapInArrow(rank, "fp long, rank long").repartitionByRange(ranges, "rank")
    ranked = stored(ranked.withColumn("part", F.spark_partition_id()), "gray-ranges")
    nodes = ranked.groupBy("part").agg(F.min("rank").alias("rank"), F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).orderBy("rank").collect()
    shared = [np.array([r[c] for r in nodes], np.int64).view(np.uint64) for c in ("all", "any")]
    directory = spark.sparkContext.broadcast((np.array([r["part"] for r in nodes]), *shared))
    pruned = spark.sparkContext.accumulator(0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, fixed, any_ = directory.value
        tree, position = GrayTree(fixed, fixed ^ any_), np.empty(parts.max() + 1, np.int64)
        position[parts] = np.arange(len(parts))
        for batch in batches:
            fp, own = batch.column(0).to_numpy(), position[batch.column(1).to_numpy()]
            query, leaf = (np.concatenate(x) for x in zip(*tree.search(fp.view(np.uint64), radius), strict=True))
            later = np.flatnonzero(leaf >= own[query])  # each pair of ranges meets in the later one
            query, leaf = query[later], leaf[later]
            visits = leaf != own[query]
            order = np.lexsort((visits, leaf))
            query, leaf, visits = query[order], leaf[order], visits[order]
            cuts = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (visits[1:] != visits[:-1])])
            packets = [part.tobytes() for part in np.split(fp[query], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(leaf[cuts]), pa.array(visits[cuts]), pa.array(packets, pa.binary())], ["task", "visits", "codes"])
        pruned.add(tree.pruned)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bool, np.ndarray]]:
            for batch in batches:
                for task, visits, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield task, visits, np.frombuffer(codes, np.uint64)

        for _, group in groupby(pieces(), lambda x: x[0]):
            rows = iter(group)
            held, rest = [], None
            for _, visit, fps in rows:
                if visit:
                    rest = fps
                    break
                held.append(fps)
            visitors = chain([] if rest is None else [rest], (fps for _, _, fps in rows))
            for a, b in _range_edges(np.concatenate(held), visitors, radius, pruned):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

    routed = ranked.select("fp", "part").mapInArrow(route, "task long, visits boolean, codes binary")
    found = stored(routed.repartitionById(len(nodes), F.col("task").cast("int")).sortWithinPartitions("task", "visits").mapInArrow(search, schema), "code-edges")
    directory.unpersist()
    dropped(ranked)
    log.info("gray index: %d codes in %d ranges, %d nodes left above the leaves", n, len(nodes), pruned.value)
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "codes")
    edges = near_edges(codes, radius)
    joined = stored(connected_components(edges).select(F.col("id").alias("fp"), "component"), "code-components")
    dropped(edges)
    least = codes.join(joined, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    moved = joined.join(least, "component").select("fp", "component_id")
    labels = codes.join(moved, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first_id").alias("component_id"))
    labels = stored(labels, "code-labels")
    total = prints.count()
    heavy = F.col("copies") >= max(2, -(-total // MOST_HEAVY))
    many = F.broadcast(labels.where(heavy).select("fp", F.struct("component_id").alias("known")))
    placed = prints.join(many, "fp", "left")
    few = placed.where(F.col("known").isNull()).drop("known").join(labels.where(~heavy).select("fp", "component_id"), "fp")
    out = placed.where(F.col("known").isNotNull()).select("fp", "doc_id", "known.component_id").unionByName(few)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id; rows without an id stay."""
    own = groups(docs, id_col, text_col, shingle, radius)
    chosen = own.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col))
    counts = stored(chosen.groupBy(id_col).agg(F.count(F.lit(1)).alias("__rows")), "kept-ids")
    # Merge joins at every size: the texts are dealt by id once, so the cost stays in proportion to the input.
    out = docs.join(counts.where(F.col("__rows") == 1).hint("merge"), id_col, "left_semi")
    more = counts.where(F.col("__rows") > 1)
    if not more.isEmpty():
        out = out.unionByName(docs.join(more.hint("merge"), id_col, "left_semi").dropDuplicates([id_col]))
    return out.unionByName(docs.where(F.col(id_col).isNull()))
