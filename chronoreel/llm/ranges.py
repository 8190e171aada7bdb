"""Order over a whole table without a task that sees all of a group.

Rows are dealt into ranges of their order and sorted there; a table of one row for each range and group says
how much of the group lies before. A group may so be as large as the table: it is spread over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, stored

LEAST_ROWS, MOST_ROWS = 5_000, 200_000  # of a range
SHARE = 10_000


def in_ranges(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``df`` (a stored table) dealt and sorted by ``order``, stored, with __part (its range) and __at, which rises in that order.

    Rows that agree in all of ``order`` are dealt too, so repeated rows are no hot range.
    """
    rows = df.count()
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("__tie"))
    placed = dealt.sortWithinPartitions(*order, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    return stored(placed.withColumn("__part", F.shiftright("__at", 33)), tag)


def parts_of(rows: DataFrame, group: list[str]) -> DataFrame:
    """(__part, group, __first, __n, __before, __total): for each range and group its first __at, rows, the group's rows in earlier ranges and in all.

    A group has as many rows here as ranges.
    """
    parts = rows.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    mine = Window.partitionBy(*group)
    return parts.withColumn("__before", earlier("__n", group)).withColumn("__total", F.sum("__n").over(mine))


def earlier(column: str, group: list[str]) -> Column:
    """The sum of ``column`` over the group's earlier ranges."""
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0).cast("long"))


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null equals null; the right side's keys go."""
    other = right.select(*[F.col(c).alias(f"__other_{c}") if c in on else F.col(c) for c in right.columns])
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(other[f"__other_{c}"])
    return left.join(other, match, how).drop(*[f"__other_{c}" for c in on])


def placed(rows: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with pos, from 0 in their group, and what else ``parts`` has. A key of this join is at most one range."""
    found = same(rows, bounded(parts, "parts"), ["__part", *group])
    return found.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))


def spread(many: DataFrame, one: DataFrame, on: list[str], rows: str, total: int, tag: str, how: str = "inner") -> DataFrame:
    """Join with a table of unique keys, of which each says in ``rows`` how many rows of ``many`` it meets at most, ``total`` in all.

    Keys with over a 10,000th of the rows are at most 10,000, and so can be broadcast; the others are small keys.
    A left join keeps rows that meet no key, or a null one.
    """
    kept = stored(one, tag)
    heavy = F.col(rows) * SHARE > total
    few = F.broadcast(kept.where(heavy).withColumn("__heavy", F.lit(True)))
    first = many.join(few, on, "left")
    own = [c for c in one.columns if c not in on]
    met = first.where(F.col("__heavy")).drop("__heavy")
    rest = first.where(F.col("__heavy").isNull()).drop("__heavy", *own).join(kept.where(~heavy), on, how)
    return met.select(*rest.columns).unionAll(rest)
