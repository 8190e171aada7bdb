"""Embedding near-dedup by spherical k-means cells and blocked cosine products.

Equal vectors are merged first (the merge combines before the shuffle), with how many rows they stand
for. Cells grow with the square root of the vectors, so the work of a vector does too. Centroids are fitted
on a bounded sample: up to FLAT cells on the driver; above, top cells there, and each top cell's own cells
in one task from a sample of it. Every vector lives in its nearest cell and visits its ``probes`` nearest
ones, but for those in which no vector linked to it can live. A cell's members are dealt into blocks; visitors stream past a block, and each batch of them is one
matrix product with it in double precision. A pair that both sides find counts once. A block emits link
counts and a spanning forest of its links, never the pairs. Components join the forests, and the
representative of a component is its smallest id.

A pair is found if one vector's cell is among the other's nearest; with ``probes`` = 0 every vector visits
all cells, which is exact and takes the square of the vectors in products. Measured recall of the default is
in the README.

Defined cases: vectors that are null, of zero length, empty, or with null, NaN or infinite components link
with nothing and are kept; vectors of different length never link; repeated rows and equal vectors count
as links of each other; a null id never becomes a component's id unless all are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, dropped, stored
from chronoreel.llm.components import connected_components, local_labels

THRESHOLD = 0.9
SAMPLE_ROWS = 32_768  # at most about so many vectors fit the centroids
SAMPLE_BYTES = 48 << 20
FLAT = 512  # cells that the driver fits at once
CENTROID_BYTES = 64 << 20  # of all centroids, which go to every worker: 65,536 cells of 256 numbers
PROBES = 12
BLOCK_ROWS = 4096
VISITORS = 1024  # rows of a product
ROW = "dim int, cell long, visits boolean, cls long, copies long, home long, probes binary, v binary"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one; the largest component goes first, against overflow."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids; an empty cell takes over a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 2048))])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1))
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def nearest_cells(x: np.ndarray, centroids: np.ndarray, probes: int, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each row, and its ``probes`` nearest (0: all), ascending by number; -1 for none.

    With a ``threshold``, cells are left out that cannot be the nearest of any vector linked to the row. Seen
    from x, the nearest of a linked y can change from h to c only if x (h - c) is at most tan(angle) times the
    part of h - c across x.
    """
    k = len(centroids)
    m = min(probes, k) or k
    home, near = np.empty(len(x), np.int64), np.empty((len(x), m), np.int64)
    step = max(1, (1 << 22) // k)
    for at in range(0, len(x), step):
        score = x[at : at + step] @ centroids.T
        own = score.argmax(axis=1)
        cells = np.argpartition(-score, m - 1, axis=1)[:, :m]
        cells[~(cells == own[:, None]).any(axis=1), 0] = own[~(cells == own[:, None]).any(axis=1)]  # a tie at the edge
        if threshold is not None and 0 < threshold < 1:
            for j in range(m):
                c = cells[:, j]
                gap = score[np.arange(len(own)), own] - score[np.arange(len(own)), c]
                across = np.sqrt(np.maximum(((centroids[own] - centroids[c]) ** 2).sum(axis=1) - gap * gap, 0))
                cells[(gap > (1 - threshold**2) ** 0.5 / threshold * across + 1e-9) & (c != own), j] = -1
        home[at : at + step], near[at : at + step] = own, np.sort(cells, axis=1)
    return home, near


class Block:
    """Members of a cell, and what they link to among the rows that visit it."""

    def __init__(self, cell: int, x: np.ndarray, cls: np.ndarray, copies: np.ndarray, probes: np.ndarray, threshold: float):
        self.cell, self.x, self.cls, self.copies, self.probes, self.threshold = cell, x, cls, copies, probes, threshold
        self.counts, self.labels = np.zeros(len(x), np.int64), np.arange(len(x))

    def visit(self, x: np.ndarray, cls: np.ndarray, copies: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each visitor's links, and the class that it is connected to here (its own if none).

        Both rows of a pair may visit the other's cell; then it counts in the lower cell, and inside one
        cell at the row with the lower number.
        """
        i, j = np.nonzero(x @ self.x.T >= self.threshold)
        same = home[i] == self.cell
        both = (self.probes[j] == home[i][:, None]).any(axis=1)
        keep = np.where(same, cls[i] < self.cls[j], ~both | (self.cell < home[i]))
        i, j = i[keep], j[keep]
        counts = np.zeros(len(x), np.int64)
        np.add.at(counts, i, self.copies[j])
        np.add.at(self.counts, j, copies[i])
        n = len(self.x)
        joined = local_labels(n + len(x), np.concatenate([np.arange(n), n + i]), np.concatenate([self.labels, j]))
        self.labels = joined[:n]
        to = joined[n:]
        return counts, np.where(to < n, self.cls[np.minimum(to, n - 1)], cls)


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(values), kind).reshape(len(values), -1))


def _sampled(classes: DataFrame, share: float) -> DataFrame:
    return classes.where(F.pmod(F.xxhash64(F.lit("sample"), "v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v")


def _centroids(classes: DataFrame, rows: int, flat: int = FLAT) -> dict[int, np.ndarray]:
    """Centroids by vector length, from samples that the hash of the vector draws."""
    dims = classes.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1
    most = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    pdf = _sampled(classes, min(1.0, most / max(rows, 1))).toPandas()
    out: dict[int, np.ndarray] = {}
    lengths = pdf["v"].map(len)
    for d in map(int, lengths.unique()):
        x = unit(np.stack(pdf["v"][lengths == d].to_numpy()))
        own = rows * len(x) / len(pdf)
        cells = max(1, min(round(own**0.5 / 2), CENTROID_BYTES // (4 * d)))
        if cells <= flat:
            out[d] = spherical_kmeans(x, max(1, min(len(x), cells)))
            continue
        top = spherical_kmeans(x, max(2, round(cells**0.5)))
        out[d] = _cells_of(classes.where(F.size("v") == d), top, own, cells, most)
    return out


def _cells_of(classes: DataFrame, top: np.ndarray, rows: float, cells: int, most: int) -> np.ndarray:
    """Cells of each top cell, as many as its share, each fitted in one task on at most about ``most`` vectors."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"top": nearest_cells(unit(np.stack(pdf["v"].to_numpy())), top, 1)[0], "v": pdf["v"]})

    kind = classes.schema["v"].dataType.simpleString()
    placed = stored(_sampled(classes, min(1.0, 32 * cells / rows)).mapInPandas(place, f"top long, v {kind}"), "vector-sample")
    held = {r["top"]: r["n"] for r in placed.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(held.values())
    limits = F.create_map(*[F.lit(v) for t, n in held.items() for v in (t, int(min(1.0, most / n) * (1 << 30)))])
    chosen = placed.where(F.pmod(F.xxhash64(F.lit("cell"), "v"), F.lit(1 << 30)) <= limits[F.col("top")])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf["v"].to_numpy()))
        found = spherical_kmeans(x, max(1, min(len(x) // 8, round(cells * held[key[0]] / total))), seed=int(key[0]))
        return pd.DataFrame({"c": [r.astype(np.float32).tobytes() for r in found]})

    found = chosen.groupBy("top").applyInPandas(fit, "c binary").toArrow().column("c").to_pylist()
    dropped(placed)
    return np.stack([np.frombuffer(c, np.float32) for c in sorted(found)]).astype(np.float64)


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind, dtype = ("array<float>", "<f4") if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else ("array<double>", "<f8")
    v = F.col(vector_col).cast(kind)
    fine = F.size(v) > 0
    fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
    merged = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    classes = stored(merged.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    cells = spark.sparkContext.broadcast(_centroids(classes, classes.count()))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                raw = part.column(0).flatten().to_numpy().astype(dtype).reshape(-1, d)
                known = cells.value.get(d, np.ones((1, d)))
                home, near = nearest_cells(unit(raw), known, probes, threshold)
                n, m = near.shape
                v, own = [r.tobytes() for r in raw], [r.tobytes() for r in near]
                cls, copies = part.column(1), part.column(2)
                for cell, visits in ((home, False), *((near[:, k], True) for k in range(m))):
                    columns = [np.full(n, d, np.int32), cell, np.full(n, visits), cls, copies, home, pa.array([None] * n if visits else own, pa.binary()), pa.array(v, pa.binary())]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names).filter(pa.array(cell >= 0))

    placed = stored(classes.select("v", "cls", "copies").mapInArrow(assigned, ROW), "vector-cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count_if(~F.col("visits")).alias("c"), F.count_if("visits").alias("asks"))
    sizes = bounded(sizes.where((F.col("c") > 0) & (F.col("asks") > 1)).select("dim", "cell", "c"), "cell-sizes")
    parts = F.ceil(F.col("c") / BLOCK_ROWS)
    own = F.array(F.pmod(F.xxhash64("cls"), parts))
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("part", F.explode(F.when(F.col("visits"), every).otherwise(own))).drop("c")
    dealt = dealt.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cls: np.ndarray, n: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
            hit = (n > 0) | (root != cls)
            return pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (cls, n, root)], ["cls", "n", "root"])

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                at = {name: i for i, name in enumerate(batch.schema.names)}
                key = np.stack([batch.column(at[k]).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("dim", "cell", "part", "visits")])
                cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    if a < b:
                        part = batch.slice(a, b - a)
                        yield tuple(key[:3, a].tolist()), bool(key[3, a]), {k: part.column(at[k]) for k in ("cls", "copies", "home", "probes", "v")}

        for (_, cell, _), group in groupby(pieces(), lambda x: x[0]):
            items = iter(group)
            held, rest = [], None
            for _, visits, columns in items:
                if visits:
                    rest = columns
                    break
                held.append(columns)
            if not held or rest is None:
                continue
            join = lambda name, held=held: np.concatenate([h[name].to_numpy() for h in held])
            near = np.frombuffer(b"".join(x for h in held for x in h["probes"].to_pylist()), np.int64).reshape(sum(len(h["cls"]) for h in held), -1)
            block = Block(cell, _matrix([x for h in held for x in h["v"].to_pylist()], dtype), join("cls"), join("copies"), near, threshold)
            for columns in chain([rest], (c for _, _, c in items)):
                values = columns["v"].to_pylist()
                cls, copies, home = (columns[k].to_numpy() for k in ("cls", "copies", "home"))
                for at in range(0, len(values), VISITORS):
                    here = slice(at, at + VISITORS)
                    n, root = block.visit(_matrix(values[here], dtype), cls[here], copies[here], home[here])
                    yield out(cls[here], n, root)
            yield out(block.cls, block.counts, block.cls[block.labels])

    found = stored(dealt.mapInArrow(compare, "cls long, n long, root long"), "vector-links")
    dropped(placed)
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    edges = found.where(F.col("cls") != F.col("root")).select(F.col("cls").alias("src"), F.col("root").alias("dst"))
    joined = stored(connected_components(edges).select(F.col("id").alias("cls"), "component"), "vector-components")
    least = classes.select("cls", "first_id").join(joined, "cls").groupBy("component").agg(F.min("first_id").alias("component_id"))
    moved = joined.join(least, "component").select("cls", "component_id")
    labels = classes.join(counts, "cls", "left").join(moved, "cls", "left")
    labels = labels.select(
        "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    linked = rows.where(F.col("v").isNotNull()).join(labels, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB form of ``links``: all pairs, so for small tables only; it agrees where every link is found.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
u AS (SELECT vec_id, r, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e, len(e) AS d FROM v WHERE e IS NOT NULL),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.d = b.d AND a.r <> b.r AND list_dot_product(a.e, b.e) >= 0.9),
c AS (SELECT r AS start, r AS at FROM v UNION SELECT c.start, l.b FROM c JOIN l ON c.at = l.a),
k AS (SELECT c.start, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.at GROUP BY c.start),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, k.component_id, v.vec_id IS NOT DISTINCT FROM k.component_id AS kept
FROM v JOIN k ON k.start = v.r LEFT JOIN n ON n.a = v.r
"""
