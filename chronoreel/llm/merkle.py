"""A Merkle tree over ``documents``: leaves, roots of sources, the root of all, and a proof for each row.

H is the lowercase hex SHA-256 of its inputs, one after the other, digests as hex text. A leaf is H of its fields,
each ``-`` if null, else its UTF-8 byte count, a colon and the value. The leaves of a source ascend by id; every
three consecutive nodes (the last run may be shorter, even one) become their H, until one is left, the subroot. The
subroots, ordered by source (null first, by UTF-8 bytes), become the root in the same way.

How: Spark hashes the leaves where the texts are, and only digests travel from there on. Rows are numbered in
ranges (``ranges``), so a source may hold any share of them. Blocks of 3^LEVELS consecutive leaves are whole subtrees;
a bucket of whole blocks goes to DuckDB as Arrow, in which one query sums up all levels with ordered ``string_agg``
and ``sha256``. The blocks' roots are the nodes of the next round, and so on; then the sources. On the way back
each block's outer proof is joined to its nodes: at most 3^LEVELS rows meet one row.

Defined cases: null ids come first in their source, count as the empty text where the id's crc32 is asked, and rows
with the same id are ordered by their leaf (equal rows take either place). Null texts and other nulls are ``-``. Long texts are hashed whole.
No documents: no rows. Other columns are left out of the tree and of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, crc_sql, dropped, fold, stored
from chronoreel.llm.ranges import in_ranges, parts_of, placed

#: Nodes that become one, and levels that one block has.
FAN, LEVELS = 3, 6
#: About so many nodes go to DuckDB at once; a bucket has whole blocks.
BUCKET_ROWS = 4_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<l: string, r: string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """H of a row's fields; ``changed`` replaces some."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def level_query(levels: int) -> str:
    """DuckDB SQL over ``nodes`` (g, pos, n, h, ...) in whole blocks: each node with path, its siblings left and right level by level, and top, its block's root.

    A group of n nodes has more than one at a level if n > 3^level; from there on its only node stays as it is.
    """
    parts = ["n0 AS MATERIALIZED (SELECT g, pos AS p, n, h FROM nodes)"]
    joins, steps = [], []
    for j in range(levels):
        run = f"(PARTITION BY g, p // {FAN} ORDER BY p ROWS BETWEEN"
        parts.append(
            f"s{j} AS MATERIALIZED (SELECT g, p, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{j} WHERE n > {FAN**j})"
        )
        parts.append(
            f"n{j + 1} AS MATERIALIZED (SELECT g, p // {FAN} AS p, n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM n{j} WHERE n > {FAN**j} GROUP BY g, p // {FAN}, n "
            f"UNION ALL SELECT g, p, n, h FROM n{j} WHERE n <= {FAN**j})"
        )
        joins.append(f"LEFT JOIN s{j} ON s{j}.g = x.g AND s{j}.p = x.pos // {FAN**j}")
        steps.append(f"CASE WHEN s{j}.g IS NOT NULL THEN {{'l': s{j}.l, 'r': s{j}.r}} END")
    return (
        f"WITH {', '.join(parts)} SELECT x.*, list_filter([{', '.join(steps)}], lambda s: s IS NOT NULL) AS path, t.h AS top FROM nodes x "
        f"JOIN n{levels} t ON t.g = x.g AND t.p = x.pos // {FAN**levels} {' '.join(joins)} ORDER BY x.g, x.pos"
    )


def climb(nodes: DataFrame, levels: int = LEVELS, tag: str = "nodes") -> DataFrame:
    """One round: ``nodes`` (g, pos, n, h, and any others), stored with path and top."""
    sql, block = level_query(levels), FAN**levels
    names = nodes.columns
    rows = nodes.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = nodes.withColumn("__bucket", F.pmod(F.xxhash64("g", F.floor(F.col("pos") / block)), F.lit(buckets)))

    def levels_of(bucket):
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            db.register("nodes", bucket.select(names))
            return db.sql(sql).to_arrow_table()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return stored(dealt.groupBy("__bucket").applyInArrow(levels_of, f"{schema}, path {_PATH}, top string"), tag)


def _rounds(nodes: DataFrame, most: int, levels: int, tag: str) -> list[DataFrame]:
    """Rounds until each group, of at most ``most`` nodes, has one block."""
    block = FAN**levels
    out = [climb(nodes, levels, tag)]
    while most > block:
        most = -(-most // block)
        heads = out[-1].where(F.col("pos") % block == 0)
        up = heads.select("g", (F.col("pos") / block).cast("long").alias("pos"), F.ceil(F.col("n") / block).cast("long").alias("n"), F.col("top").alias("h"))
        out.append(climb(up, levels, tag))
    return out


def _with_outer(nodes: DataFrame, outer: DataFrame, on: list[str], *more: str) -> DataFrame:
    """``nodes`` with the outer path of their block behind their own."""
    found = nodes.join(bounded(outer.select(*on, F.col("path").alias("__outer"), *more), "outer"), on)
    return found.withColumn("path", F.concat("path", "__outer")).drop("__outer")


def _down(rounds: list[DataFrame], levels: int, last: DataFrame) -> DataFrame:
    """The first round's nodes with whole paths; ``last`` is the last round's table, whose paths are whole already. subroot goes along if it is there."""
    now = last
    more = [c for c in ("subroot",) if c in last.columns]
    for nodes in reversed(rounds[:-1]):
        up = now.select("g", F.col("pos").alias("__block"), "path", *more)
        now = _with_outer(nodes.withColumn("__block", (F.col("pos") / FAN**levels).cast("long")), up, ["g", "__block"], *more).drop("__block")
    return now


def manifest(docs: DataFrame, levels: int = LEVELS, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered``: the text that a row is checked with; its own by default.
    """
    changed = F.col("text") if tampered is None else tampered
    rows = docs.select("doc_id", "source", leaf().alias("h"), F.nullif(leaf(text=changed), leaf()).alias("other"))
    leaves = stored(rows, "leaves")
    if leaves.isEmpty():
        return _result(leaves.withColumns({"path": F.array().cast(_PATH), "subroot": F.lit(None).cast("string")}), "")
    dealt = in_ranges(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("h")], "leaves-in-order")
    dropped(leaves)
    parts = stored(_numbered_sources(parts_of(dealt, ["source"])), "source-parts")
    whole = parts.agg(F.max("__total").alias("most"), (F.max("g") + 1).alias("sources")).first()
    nodes = placed(dealt, parts, ["source"]).select("g", "pos", F.col("__total").alias("n"), "h", "doc_id", "source", "other")
    inner = _rounds(nodes, whole["most"], levels, "tree")
    subroots = inner[-1].where(F.col("pos") == 0).select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(whole["sources"]).cast("long").alias("n"), F.col("top").alias("h"))
    outer = _rounds(subroots, whole["sources"], levels, "source-tree")
    root = outer[-1].where(F.col("pos") == 0).first()["top"]
    by_source = _down(outer, levels, outer[-1]).select(F.col("pos").alias("g"), "path", F.col("h").alias("subroot"))
    return _result(_down(inner, levels, _with_outer(inner[-1], by_source, ["g"], "subroot")), root)


def _numbered_sources(parts: DataFrame) -> DataFrame:
    """``parts`` with g: the number of their source in order, by the ranges' order; the sources that begin in one range are numbered there."""
    from pyspark.sql import Window

    kept = stored(parts, "parts")
    first = kept.where(F.col("__before") == 0)
    begins = first.groupBy("__part").agg(F.count(F.lit(1)).alias("__k"))
    # One row a range.
    begins = begins.select("__part", F.coalesce(F.sum("__k").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    here = F.row_number().over(Window.partitionBy("__part").orderBy("__first")) - 1
    numbers = first.withColumn("__here", here).join(begins, "__part").select("source", (F.col("__offset") + F.col("__here")).cast("long").alias("g"))
    mine = bounded(numbers, "source-numbers").withColumnRenamed("source", "__source")
    return kept.join(mine, kept["source"].eqNullSafe(mine["__source"])).drop("__source")


def _result(rows: DataFrame, root: str) -> DataFrame:
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["l"], s["r"]))), "")
    folded = F.aggregate("path", F.coalesce("other", "h"), lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))
    out = rows.select("doc_id", "source", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_lines() -> Column:
    """The text without line breaks where 2 divides the id's crc32, else as it is."""
    return F.when(fold("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


#: DuckDB form of ``manifest`` with ``tampered_lines``.
ORACLE = """
WITH RECURSIVE
d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN @CRC_OF@ % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
f AS (SELECT doc_id, source, @HEAD@ || @TEXT(text)@ AS a, @HEAD@ || @TEXT(other)@ AS b FROM d),
v AS (SELECT doc_id, source, sha256(a) AS leaf, sha256(b) AS other FROM f),
lv AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM v),
t AS (
  SELECT g, 0 AS lev, pos AS p, leaf AS h, n FROM lv
  UNION ALL
  SELECT g, lev + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY g, lev, p // 3, n),
sr AS (SELECT g, h AS subroot FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lev, g AS p, subroot AS h, count(*) OVER () AS n FROM sr
  UNION ALL
  SELECT lev + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lev, p // 3, n),
ro AS (SELECT h AS root FROM u WHERE n = 1),
sb AS (
  SELECT g, lev, p, coalesce(string_agg(h, '') OVER (PARTITION BY g, lev, p // 3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lev, p // 3 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM t WHERE n > 1
  UNION ALL
  SELECT NULL, lev, p, coalesce(string_agg(h, '') OVER (PARTITION BY lev, p // 3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(h, '') OVER (PARTITION BY lev, p // 3 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM u WHERE n > 1),
st AS (
  SELECT lv.g, lv.pos, sb.lev, sb.l, sb.r FROM lv JOIN sb ON sb.g = lv.g AND sb.p = lv.pos // (3 ** sb.lev)::BIGINT
  UNION ALL
  SELECT lv.g, lv.pos, 1000 + sb.lev, sb.l, sb.r FROM lv JOIN sb ON sb.g IS NULL AND sb.p = lv.g // (3 ** sb.lev)::BIGINT),
so AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY lev) AS step FROM st),
fo AS (
  SELECT g, pos, 0::BIGINT AS step, other AS h FROM lv
  UNION ALL
  SELECT fo.g, fo.pos, so.step, sha256(so.l || fo.h || so.r) FROM fo JOIN so ON so.g = fo.g AND so.pos = fo.pos AND so.step = fo.step + 1),
en AS (SELECT g, pos, arg_max(h, step) AS folded_root FROM fo GROUP BY g, pos),
pr AS (SELECT g, pos, string_agg(l || r, '' ORDER BY step) AS proof FROM so GROUP BY g, pos)
SELECT doc_id, lv.source, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM lv JOIN sr USING (g) CROSS JOIN ro JOIN en USING (g, pos) LEFT JOIN pr USING (g, pos)
"""


def _sql() -> str:
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    head = " || ".join(field(c) for c in FIELDS[:-1])
    out = ORACLE.replace("@HEAD@", head).replace("@TEXT(text)@", field("text")).replace("@TEXT(other)@", field("other"))
    return out.replace("@CRC_OF@", crc_sql("doc_id"))


ORACLE = _sql()
