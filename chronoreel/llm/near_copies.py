"""One document of each group of near-copies: SimHash candidates, exact Jaccard.

Two texts are near-copies where the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more; groups are connected components. Texts with equal words are merged first. Sets of similarity 0.8 differ in
about 15% of the bits of a SimHash, 10 of 64, and within so many bits a Gray-order index of whole codes leaves nothing out.
The index therefore holds TABLES codes of 24 bits for each text, from bits of its SimHash that no other code uses: two texts meet
where in one table the first EXACT bits are equal and the rest differ in at most NEAR. The first bits name
the task, and inside it a Gray-order tree (``simhash.GrayTree``) is searched within NEAR, which leaves nearly all of it out. At similarity 0.8
one table finds a pair with odds of 0.149 and none does with odds of 0.0004. Of the pairs that meet, those whose further 64-bit SimHashes are within RADIUS bits and
128-bit ones within BOTH are candidates; the radii leave room.

Candidates are checked on the sets themselves. A text with few candidates sends its pairs; those of crowded
texts, whose pairs would grow with the square of a group, are checked inside tasks that hold their sets,
and send at most one link a text. To that end the crowded texts alone are sent to the groups
of their LOWEST smallest shingle hashes. Of two sets of similarity 0.8 each one's smallest are in the other but
for a fifth, so they share none with odds of about 0.2 ** LOWEST. A shingle that more than a
BLOCK of them have among their ROOTS smallest (a licence line, a site's template) is left out where a text has
ENOUGH others there, the smallest of which take its place; the odds are 0.2 ** ENOUGH at worst then. A crowd of near-copies is dealt out in pairs of blocks.

Defined cases: a null text counts as empty; texts without words are copies of each other; one of fewer than
five words is one shingle; rows without an id stay, though they may link others; of a group the row with the
smallest id stays, and of equal rows one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, dropped, stored, text_or_empty
from chronoreel.llm.components import connected_components
from chronoreel.llm.simhash import GrayTree, gray_rank

SHINGLE = 5
RADIUS = 17
BOTH = 30
FEW = 8  # candidates of a text in a task that are sent as pairs
SETS = 512  # rows of a block that hold their sets
LOWEST = 6
ROOTS, ENOUGH = 12, 4
BLOCK = 8192  # texts of a block in a crowded group
TABLES = 48  # codes of a text in the index, of three bytes each
EXACT = 8  # bits of a code that are equal: its last byte
NEAR = 2  # bits that the other 16 may differ in
CELL = 1 << 17  # texts of a table with the same last byte that are one task; more are dealt out in pairs of blocks
WORDS = TABLES * 3 // 8
SEEDS = np.frombuffer(b"".join(xxhash.xxh3_64_digest(b"table bits %d" % i) for i in range(WORDS)), "<u8")


def shingles(words: list[bytes]) -> np.ndarray:
    """128-bit hashes (n x 2) of the distinct shingles, by their first half."""
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) > SHINGLE else [words]
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(run)) for run in runs), "<u8").reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The two SimHashes of a set of shingles."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def wide_sketch(hashes: np.ndarray) -> bytes:
    """The SimHash of TABLES * 24 bits of a set of shingles, from their first halves mixed anew for each 64 bits."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4080):
        x = (hashes[at : at + 4080, :1] ^ SEEDS) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for begin in range(0, len(bits), 255):  # as many as a byte counts
            ones += bits[begin : begin + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest of the text, key (of its words), n shingles, codes a and b, the lowest shingle hashes, the wide sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, lowest, wide, codes = [], [], [], [], np.zeros((batch.num_rows, 2), np.uint64)
            for i, x in enumerate(batch.column(2)):
                words = x.as_py().lower().split()
                keys.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                found = shingles(words) if words else np.empty((0, 2), np.uint64)
                sizes.append(len(found))
                lowest.append(np.ascontiguousarray(found[:ROOTS, 0]).view(np.int64))
                codes[i] = sketch(found) if words else 0
                wide.append(wide_sketch(found) if words else b"")
            made = [np.array(keys, np.uint64).view(np.int64), np.array(sizes, np.int64), *np.ascontiguousarray(codes.T).view(np.int64)]
            made = [*map(pa.array, made), pa.array(lowest, pa.list_(pa.int64())), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "digest", "key", "n", "a", "b", "lowest", "wide"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, digest long, key long, n long, a long, b long, lowest array<long>, wide binary")


def candidates(n: np.ndarray, a: np.ndarray, b: np.ndarray, side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of positions, and the bits they differ in: within a block, or across two (``side``)."""
    order = np.argsort(n, kind="stable")
    left = order[side[order] == side.min()] if cross else order
    right = order[side[order] != side.min()] if cross else order
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
    sizes, others, codes = n[right], b[right], a[right]
    for at in range(0, len(left), 256):
        own = left[at : at + 256]
        begin = int(np.searchsorted(sizes, -(-4 * n[own[0]] // 5))) if cross else at
        end = int(np.searchsorted(sizes, 5 * n[own[-1]] // 4, side="right"))
        for begin in range(begin, end, 8192):
            until = min(end, begin + 8192)
            i, j = np.nonzero(np.bitwise_count(a[own][:, None] ^ codes[None, begin:until]) <= RADIUS)
            gap = np.bitwise_count(a[own[i]] ^ codes[begin + j]).astype(np.int64) + np.bitwise_count(b[own[i]] ^ others[begin + j])
            p, q = own[i], right[begin + j]
            good = (gap <= BOTH) & (5 * np.minimum(n[p], n[q]) >= 4 * np.maximum(n[p], n[q]))
            if not cross:
                good &= at + i < begin + j
            for part, x in zip(found, (p[good], q[good], gap[good]), strict=True):
                part.append(x)
    p, q, gap = (np.concatenate(x) for x in found)
    return p, q, gap


def _tasks(nodes: DataFrame, block_rows: int) -> DataFrame:
    """``nodes`` (with key and lowest) at each of the groups of their lowest hashes that have others, dealt out in pairs of blocks."""
    names = [c for c in nodes.columns if c != "lowest"]
    routed = nodes.where(F.col("n") > 0).select(*names, F.explode("lowest").alias("root"))
    return _dealt(routed, routed.groupBy("root").agg(F.count(F.lit(1)).alias("c")), names, block_rows)


def _dealt(routed: DataFrame, counts: DataFrame, names: list[str], block_rows: int) -> DataFrame:
    """Rows at each root that others have too, by task: a pair of blocks of a root."""
    shared = counts.where(F.col("c") > 1)
    parts = F.ceil(F.col("c") / block_rows)
    dealt = routed.join(shared, "root").withColumn("side", F.pmod(F.xxhash64("key"), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    task = F.xxhash64("root", F.least("side", "other"), F.greatest("side", "other"))
    return dealt.select(task.alias("task"), *names, "side", (F.col("side") != F.col("other")).alias("cross")).repartition("task").sortWithinPartitions("task")


def _codes(wide: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text and table: the table's number and the code's last byte as one number, and its other 16 bits."""
    three = np.frombuffer(b"".join(wide.to_pylist()), np.uint8).reshape(-1, TABLES, 3).astype(np.int64)
    return (np.arange(TABLES) << EXACT) + three[:, :, 2], three[:, :, 0] | three[:, :, 1] << 8


def _cells(nodes: DataFrame, block_rows: int) -> DataFrame:
    """``nodes`` (with key, n, a, b and wide) at each of their places in the index, by task, with low, the bits that the tree is over."""
    rows = nodes.where(F.col("n") > 0)
    names = ["key", "n", "a", "b"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TABLES << EXACT, np.int64)
        for batch in batches:
            seen += np.bincount(_codes(batch.column(0))[0].ravel(), minlength=len(seen))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["root", "c"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                root, low = _codes(batch.column(4))
                yield pa.RecordBatch.from_arrays([pa.array(root.ravel()), *(pa.array(np.repeat(c.to_numpy(), TABLES)) for c in batch.columns[:4]), pa.array(low.ravel())], ["root", *names, "low"])

    counts = rows.select("wide").mapInArrow(count, "root long, c long").groupBy("root").agg(F.sum("c").alias("c"))
    placed = rows.select(*names, "wide").mapInArrow(place, "root long, key long, n long, a long, b long, low long")
    return _dealt(placed, F.broadcast(counts), [*names, "low"], block_rows)  # at most TABLES << EXACT counts


def _routes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with lowest cut to the LOWEST hashes that the text is sent to, crowded ones left out where others are enough."""
    kept = lambda xs: F.slice(xs, 1, LOWEST)
    places = nodes.where(F.col("n") > 0).select("key", F.posexplode("lowest").alias("place", "root"))
    crowded = places.groupBy("root").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("root")
    crowded = bounded(places.join(bounded(crowded, "crowded-roots"), "root").groupBy("key").agg(F.collect_set("place").alias("crowd")), "crowded-texts")
    found = nodes.join(crowded, "key", "left")
    free = F.filter(F.transform("lowest", lambda x, i: F.when(~F.array_contains("crowd", i), x)), lambda x: x.isNotNull())
    routes = F.when(F.col("crowd").isNull() | (F.size(free) < ENOUGH), kept(F.col("lowest"))).otherwise(kept(free))
    return found.withColumn("lowest", routes).drop("crowd")


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole tasks, at least ``least`` rows each but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            task = table.column(0).to_numpy()
            cut = int(np.flatnonzero(task != task[-1])[-1]) + 1 if task[0] != task[-1] else 0
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs_of(rows: pa.Table, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates among the rows of each task, as positions: small groups many at a time, larger ones in blocks."""
    get = lambda name: rows.column(name).to_numpy()
    task, n, a, b, side = get("task"), get("n"), get("a").view(np.uint64), get("b").view(np.uint64), get("side")
    begin = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    sizes = np.diff(np.r_[begin, len(task)])
    cross = rows.column("cross").to_numpy()
    tiny = (sizes <= small) & ~cross[begin]
    end = np.repeat(begin + sizes, sizes)
    at = np.flatnonzero(np.repeat(tiny, sizes))
    counts = end[at] - at - 1
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(counts) >> 20)) + 1):
        p = np.repeat(at[part], counts[part])
        q = np.arange(len(p)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part]) + p + 1
        first = np.bitwise_count(a[p] ^ a[q])
        near = np.flatnonzero((first <= RADIUS) & (5 * np.minimum(n[p], n[q]) >= 4 * np.maximum(n[p], n[q])))
        p, q = p[near], q[near]
        gap = first[near].astype(np.int64) + np.bitwise_count(b[p] ^ b[q])
        yield p[gap <= BOTH], q[gap <= BOTH], gap[gap <= BOTH]
    for i in np.flatnonzero(~tiny):
        here = slice(begin[i], begin[i] + sizes[i])
        p, q, gap = candidates(n[here], a[here], b[here], side[here], bool(cross[begin[i]]))
        yield p + begin[i], q + begin[i], gap


def _index_pairs(rows: pa.Table, pruned: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates among the rows of each task, as positions: one Gray-order tree over all tasks' codes, searched within NEAR.

    A task's number stands in a code three times, so codes of two tasks are more than NEAR apart.
    """
    get = lambda name: rows.column(name).to_numpy()
    task, n, a, b, side, cross = get("task"), get("n"), get("a").view(np.uint64), get("b").view(np.uint64), get("side"), rows.column("cross").to_numpy()
    first = np.r_[True, task[1:] != task[:-1]]
    number = (np.cumsum(first) & 0xFFFF).astype(np.uint64)
    code = number << np.uint64(48) | number << np.uint64(32) | number << np.uint64(16) | get("low").astype(np.uint64)
    order = np.argsort(gray_rank(code), kind="stable")
    tree = GrayTree(code[order])
    largest = int(np.diff(np.r_[np.flatnonzero(first), len(task)]).max())
    for i, j in tree.search(code[order], NEAR, at_once=min(1024, max(1, (1 << 20) // largest))):
        later = i < j
        p, q = order[i[later]], order[j[later]]
        met = (task[p] == task[q]) & (~cross[p] | (side[p] != side[q])) & (5 * np.minimum(n[p], n[q]) >= 4 * np.maximum(n[p], n[q]))
        p, q = p[met], q[met]
        near = np.bitwise_count(a[p] ^ a[q]) <= RADIUS
        p, q = p[near], q[near]
        near = np.bitwise_count(a[p] ^ a[q]) + np.bitwise_count(b[p] ^ b[q]) <= BOTH
        yield p[near], q[near]
    if pruned is not None:
        pruned.append(tree.pruned)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of texts with few in a group; each text of the other pairs alone (dst null)."""
    for rows in _whole_groups(batches):
        key = rows.column("key").to_numpy()
        for p, q in _index_pairs(rows):
            crowded = np.bincount(p, minlength=len(key))[p] > FEW
            alone = np.unique(key[np.concatenate([p[crowded], q[crowded]])])
            pairs = np.unique(np.sort(np.stack([key[p[~crowded]], key[q[~crowded]]]), axis=0), axis=1)
            src = pa.array(np.concatenate([pairs[0], alone]))
            dst = pa.array(np.concatenate([pairs[1], alone]), mask=np.arange(pairs.shape[1] + len(alone)) >= pairs.shape[1])
            yield pa.RecordBatch.from_arrays([src, dst], ["src", "dst"])


def _search_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the near-copies among the rows of each task, which hold their sets."""
    for rows in _whole_groups(batches, 1):
        key, held = rows.column("key").to_numpy().tolist(), rows.column("shingles")
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        src, dst = [], []
        for p, q, gap in _pairs_of(rows):
            order = np.argsort(gap, kind="stable")
            for x, y in zip(p[order].tolist(), q[order].tolist(), strict=True):
                if (r := root(key[x])) != (s := root(key[y])) and similar(np.frombuffer(held[x].as_py(), "<u8"), np.frombuffer(held[y].as_py(), "<u8")):
                    up[r] = s
                    src.append(key[x])
                    dst.append(key[y])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(src, dst) keys of ``nodes`` whose links connect the near-copies."""
    schema = "src long, dst long"
    sent = stored(_cells(nodes, CELL).mapInArrow(_search, schema), "candidates")
    alone = stored(sent.where(F.col("dst").isNull()).select(F.col("src").alias("key")).distinct(), "crowded")
    pairs = sent.where(F.col("dst").isNotNull()).distinct()
    asked = pairs.select(F.col("src").alias("key")).unionAll(pairs.select(F.col("dst").alias("key"))).unionAll(alone).distinct()
    wanted = bounded(nodes.join(asked, "key").select("key", F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")), "asked")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.ascontiguousarray(shingles(x.as_py().lower().split())[:, 0]).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "shingles"])

    match = F.col("own_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__digest"))
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(wanted, match).select("key", F.col("text").cast("binary").alias("text"))
    sets = stored(texts.mapInArrow(scan, "key long, shingles binary").dropDuplicates(["key"]), "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("src"), F.col("shingles").alias("x")), "src").join(sets.select(F.col("key").alias("dst"), F.col("shingles").alias("y")), "dst")
    few = both.select("src", "dst", "x", "y").mapInArrow(check, schema)
    crowd = stored(_routes(nodes.join(alone, "key").select("key", "n", "a", "b", "lowest")), "routes").join(sets, "key")
    many = _tasks(crowd, SETS).mapInArrow(_search_sets, schema)
    out = stored(few.unionAll(many), "links")
    for used in (sent, alone, sets):
        dropped(used)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-copies, that with the smallest id; rows without an id stay."""
    rows = stored(prints(docs, id_col, text_col), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    nodes = stored(rows.groupBy("key").agg(first, F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("lowest").alias("lowest"), F.first("wide").alias("wide")).select("key", "first.*", "n", "a", "b", "lowest", "wide"), "texts")
    found = stored(connected_components(links(docs, nodes, id_col, text_col)).select(F.col("id").alias("key"), "component"), "text-components")
    labels = nodes.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    chosen = labels.groupBy("component").agg(F.min(F.struct("none", "doc_id", "digest")).alias("first")).select("first.doc_id", "first.digest").where(F.col("doc_id").isNotNull())
    counts = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("__rows"))
    kept = stored(chosen.join(counts, ["doc_id", "digest"]).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "__rows"), "kept-rows")
    match = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__digest"))
    # Merge joins at every size: the texts are dealt by id once, so the cost stays in proportion to the input.
    out = docs.join(kept.where(F.col("__rows") == 1).hint("merge"), match, "left_semi")
    more = kept.where(F.col("__rows") > 1)
    if not more.isEmpty():
        again = docs.withColumn("__own", F.xxhash64(F.col(text_col).cast("string"))).join(more.hint("merge"), match, "left_semi")
        out = out.unionByName(again.dropDuplicates([id_col, "__own"]).drop("__own"))
    return out.unionByName(docs.where(F.col(id_col).isNull()))
