"""Mixing sources to target weights by Pareto order sampling.

Targets come from water-filling over the sources. Each document of a source first gets the certain
whole copies, floor(target / source size). What is left of the target, a share f of the source, is a
fixed-size sample in words with unequal probabilities: a document's inclusion odds are f/(1-f) times the
source's mean size over its own size, so a text counts for less the more of the target it would use up, and
the order is that of random odds u/(1-u) over inclusion odds, smallest first. Documents are taken in that
order as long as they fit; after one that does not, the draw goes on with those that still fit, PASSES
times in all, and then the first one in order that brings the source nearer to its target closes it.

The order is cut by words with per-source sums over buckets of the order, then inside the one bucket where
the cut falls, so that no source is ever sorted as a whole.

What the draw comes to is one row a source (``decisions``), by which each document is judged on its own:
``repeat`` applies it where the texts are, without a shuffle.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a document
of size 0 takes 0 words and counts as one word in its odds; rows with the same id are separate rows, but
those that agree in id, source and text are taken or left together; rows without an id draw their random
number from their text; an empty table gives no rows; other columns are ignored. u depends on the seed and
the id (or text) only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, stored, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
BUCKETS = 4096
PASSES = 4
SOURCES = 1_000_000  # sources that one task numbers
FEW_SOURCES = 20_000  # up to so many, tables of one row a source (under 400 bytes) are broadcast without measuring each


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size, and any others), one row a source, with its target in words.

    Sources take the weights in turn by code point, nulls last; they are numbered by ranges, SOURCES in a task.
    The level, words per unit of weight, rises from the plain share: sources that it lifts above their cap are
    held there and the others share the rest, until none is above. Each step is one sum over the table.
    """
    ranges = max(1, -(-sizes.count() // SOURCES))
    order = F.col("source").asc_nulls_last()
    dealt = stored(sizes.repartitionByRange(ranges, order).withColumn("__part", F.spark_partition_id()), "sources")
    before, at = [], 0
    for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():
        before += [F.lit(r["__part"]), F.lit(at)]
        at += r["n"]
    first = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    number = first + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    ranked = dealt.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")))
    ranked = stored(ranked.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("w")), "ranked-sources")
    level, held = 0.0, -1
    while True:
        free = F.col("ratio") > level if held >= 0 else F.lit(True)
        r = ranked.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(~free, F.col("source_size") * cap)), F.lit(0)).alias("capped"),
            F.sum(F.when(free, F.col("w"))).alias("rest"), F.count_if(~free).alias("held"),
        ).first()
        if r["rest"] is None or r["held"] == held:
            break
        level, held = float(r["all"] - r["capped"]) / r["rest"], r["held"]
    most = (F.col("source_size") * cap).cast("double")
    target = F.least(most, F.when(F.col("ratio") > level, F.lit(level) * F.col("w")).otherwise(most))
    return ranked.select(*sizes.columns, target.alias("target"))


def _nulls_match(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on source where null equals null; the right side's own columns follow."""
    other = right.withColumnRenamed("source", "other_source")
    return left.join(other, left["source"].eqNullSafe(other["other_source"]), how).drop("other_source")


#: A row's place in the order of its source.
PLACE = ("pareto", "doc_id", "digest")


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list:
    """What a document is judged by."""
    text = text_or_empty(text_col)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.md5(text.cast("binary")).alias("digest"), word_count(text).alias("size")]


def _ordered(rows: DataFrame, cuts: DataFrame, seed: str, by_size: float) -> DataFrame:
    """``rows`` with their source's decisions, their value in Pareto order and its bucket."""
    found = _nulls_match(rows, cuts)
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text:"), F.col("digest"))).otherwise(F.col("doc_id").cast("string"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    size = F.greatest(F.col("size"), F.lit(1))
    found = found.withColumn("u", u)
    found = found.withColumn("pareto", F.col("u") / (1 - F.col("u")) / (F.col("odds") / (size if by_size == 1 else F.pow(size, F.lit(by_size)))))
    # Most of the order lies around the value that a document of mean size has at u = share.
    return found.withColumn("bucket", F.floor(F.col("pareto") / (1 + F.col("pareto")) * BUCKETS).cast("int")).drop("u")


def _drawn(passes: int):
    """Whether a row with its source's decisions is drawn in one of the first passes."""
    out = F.lit(False)
    for number in range(passes):
        room, cut, last = (F.col(f"{c}_{number}") for c in ("room", "cut", "last"))
        inside = (F.col("size") <= room) & (cut.isNull() | (F.col("bucket") < cut) | F.coalesce((F.col("bucket") == cut) & (F.struct(*PLACE) <= last), F.lit(False)))
        out = out | F.coalesce(F.col("pareto").isNotNull() & inside, F.lit(False))
    return out


def decisions(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, by_size: float = 1.0) -> DataFrame:
    """One row a source: source_size, target, certain copies, odds, and where each pass and the closing document fall.

    ``base``: doc_id, source, digest, size. ``by_size``: the power of mean size over size in the inclusion odds;
    0 gives all documents of a source the same.
    """
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    shares = targets(sums, weights, cap).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    shares = shares.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.col("source_size") / F.col("n_docs")
    odds = F.when((share > 0) & (share < 1), share / (1 - share) * (mean if by_size == 1 else F.pow(mean, F.lit(by_size))))
    cuts = bounded(shares.withColumn("odds", odds).drop("n_docs"), "mix-targets")
    few = cuts.count() <= FEW_SOURCES

    def kept(df: DataFrame, tag: str) -> DataFrame:
        return F.broadcast(stored(df, tag)) if few else bounded(df, tag)

    order = stored(_ordered(base, cuts.select("source", "odds"), seed, by_size).drop("odds").where(F.col("pareto").isNotNull()), "mix-order")
    left = "left"
    for number in range(PASSES):
        free = _nulls_match(order, cuts).where(~_drawn(number)).select("source", *PLACE, "size", "bucket")
        ends = _pass(free, cuts.select("source", F.col(left).alias("left")), few, f"mix-pass-{number}")
        cuts = kept(_nulls_match(cuts, ends.select("source", *[F.col(c).alias(f"{c}_{number}") for c in ("room", "cut", "last", "gap")])), "mix-cuts")
        left = f"gap_{number}"
    gap = F.col(left)
    free = _nulls_match(order, cuts).where(~_drawn(PASSES))
    closing = kept(free.where(F.abs(F.col("size") - gap) < gap).groupBy("source").agg(F.min(F.struct(*PLACE)).alias("closing")), "mix-closing")
    # Rows that agree stand and fall together, so what they add up to has to bring the source nearer.
    alike = _nulls_match(free, closing, "inner").where(F.struct(*PLACE) == F.col("closing"))
    fits = alike.groupBy("source").agg(F.first("closing").alias("closing"), F.sum("size").alias("words"), F.first(gap).alias("gap"))
    fits = fits.where(F.abs(F.col("words") - F.col("gap")) < F.col("gap")).select("source", "closing")
    return kept(_nulls_match(cuts, fits), "mix-decisions")


def _copies(rows: DataFrame, cuts: DataFrame, seed: str, by_size: float) -> DataFrame:
    """``rows`` (with doc_id, source, digest, size) with n_copies, and their source's size and target."""
    found = _ordered(rows, cuts, seed, by_size)
    extra = _drawn(PASSES) | F.coalesce(F.col("pareto").isNotNull() & (F.struct(*PLACE) == F.col("closing")), F.lit(False))
    return found.withColumn("n_copies", F.col("copies") + extra.cast("long"))


def _pass(rows: DataFrame, gaps: DataFrame, few: bool, tag: str) -> DataFrame:
    """One pass over ``rows`` that are not drawn: (source, room, cut, last, gap), one row a source.

    Of the rows that fit what is ``left`` of their source (the room), the first ones in order that fit
    together are drawn: all in buckets below ``cut`` and those up to ``last`` in it, or all if cut is null.
    ``gap`` is what is left then.
    """
    fitting = _nulls_match(rows, gaps, "inner").where(F.col("size") <= F.col("left"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = fitting.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left")).withColumn("upto", F.sum("words").over(so_far))
    over = F.col("upto") > F.col("left")
    first = F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))))
    cuts = sums.groupBy("source").agg(first.alias("at"), F.max("upto").alias("all"))
    cuts = F.broadcast(cuts) if few else bounded(cuts, tag)
    edge = _nulls_match(fitting, cuts, "inner").where(F.col("bucket") == F.col("at.bucket"))
    edge = edge.withColumn("upto", F.col("at.before") + F.sum("size").over(Window.partitionBy("source").orderBy(*PLACE)))
    fits = F.col("upto") <= F.col("left")
    ends = edge.groupBy("source").agg(F.max(F.when(fits, F.struct(*PLACE))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("got"))
    whole = _nulls_match(_nulls_match(gaps, cuts), ends)
    got = F.when(F.col("at").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.coalesce("got", F.col("at.before")))
    return whole.select("source", F.col("left").alias("room"), F.col("at.bucket").alias("cut"), "last", (F.col("left") - got).alias("gap"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, by_size: float = 1.0, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words)."""
    base = stored(docs.select(*_rows(docs, id_col, source_col, text_col)), "mix-sizes")
    found = _copies(base, decisions(base, seed=seed, by_size=by_size, **options), seed, by_size)
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, by_size: float = 1.0, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. The texts are judged where they are, and not shuffled."""
    rows = _rows(docs, id_col, source_col, text_col)
    base = stored(docs.select(*rows), "mix-sizes")
    whole = docs.select(F.struct(*docs.columns).alias("__row"), *rows)
    found = _copies(whole, decisions(base, seed=seed, by_size=by_size, **options), seed, by_size)
    # An outer explode: a filter on n_copies would move into the join, and judge each row many times over.
    times = F.when(F.col("n_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_copies")))
    return found.select("__row", F.explode_outer(times).alias("__copy")).where(F.col("__copy").isNotNull()).select("__row.*")


def _pass_sql(name: str, before: str) -> str:
    """One pass of the draw: rest is what is left of each source, drawn what has been taken so far."""
    fits = "pareto IS NOT NULL AND NOT drawn AND size <= rest"
    return f"""
{name}_c AS (SELECT *, {fits} AS fits, sum(CASE WHEN {fits} THEN size END) OVER (PARTITION BY source ORDER BY pareto NULLS LAST, doc_id, dg) AS upto FROM {before}),
{name} AS (SELECT * EXCLUDE (fits, upto) REPLACE (drawn OR (fits AND upto <= rest) AS drawn,
  rest - max(CASE WHEN fits AND upto <= rest THEN upto ELSE 0 END) OVER (PARTITION BY source) AS rest) FROM {name}_c),"""


#: DuckDB form of ``mix`` with the production parameters.
ORACLE = """
WITH b AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    md5(coalesce(text, '')) AS dg
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, count(*) AS nd FROM b GROUP BY source),
k AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
q AS (SELECT *, 3.0::DOUBLE * ss / w AS ratio FROM k),
lv AS (
  SELECT *, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM q),
t AS (SELECT source, ss, nd, least((3 * ss)::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM lv WHERE ratio > level) * w, (3 * ss)::DOUBLE)) AS target FROM lv),
h AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::BIGINT AS copies FROM t),
l AS (SELECT *, target - copies * ss AS rest, CASE WHEN ss > 0 THEN (target - copies * ss) / ss END AS share FROM h),
d AS (
  SELECT b.*, l.ss, l.target, l.copies, l.rest,
    CASE WHEN l.share > 0 AND l.share < 1 THEN u / (1 - u) / (l.share / (1 - l.share) * (l.ss / l.nd::DOUBLE) / greatest(size, 1)) END AS pareto
  FROM b JOIN l ON b.source IS NOT DISTINCT FROM l.source),
@PASSES@
y AS (SELECT source, arg_min({'p': pareto, 'd': doc_id, 'g': dg}, (pareto, doc_id, dg)) AS c FROM @LAST@
  WHERE pareto IS NOT NULL AND NOT drawn AND abs(size - rest) < rest GROUP BY source),
z AS (SELECT g.source, any_value(y.c) AS c FROM @LAST@ g JOIN y ON g.source IS NOT DISTINCT FROM y.source AND g.pareto = y.c.p AND g.doc_id IS NOT DISTINCT FROM y.c.d AND g.dg = y.c.g
  GROUP BY g.source HAVING abs(sum(g.size) - any_value(g.rest)) < any_value(g.rest))
SELECT doc_id, g.source, size, ss AS source_size, target,
  ((copies + CASE WHEN drawn OR coalesce(pareto = z.c.p AND doc_id IS NOT DISTINCT FROM z.c.d AND dg = z.c.g, false) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM @LAST@ g LEFT JOIN z ON g.source IS NOT DISTINCT FROM z.source
"""
ORACLE = ORACLE.replace("@PASSES@", "g0 AS (SELECT *, false AS drawn FROM d)," + "".join(_pass_sql(f"g{i + 1}", f"g{i}") for i in range(PASSES))).replace("@LAST@", f"g{PASSES}")
