"""Connected components of a large graph, and of a small one in memory.

``connected_components`` alternates large-star and small-star steps. A step is a minimum per node (which
combines before the shuffle) and a join back to the edges (which adaptive execution can split where a
node has very many); no list of neighbours is ever built, and each step is written to the shared folder,
so lost executors repeat one step at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import dropped, stored


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and the edges a-b, the smallest node of each one's component."""
    labels = np.arange(n)
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (src, dst longs); component is the smallest id reachable."""
    pairs = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = stored(pairs.distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        after = stored(_small_star(_large_star(now)), "edges")
        dropped(now)
        now, last, seen = after, seen, _signature(after)
        if seen == last:
            break
    roots = now.select(F.col("dst").alias("id")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(roots.select("id", F.col("id").alias("component")))
