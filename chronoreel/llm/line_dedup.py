"""Lines that stand in many documents are kept in one of them only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys of at least
``LEAST_CHARS`` code points that are found in at least ``LEAST_DOCS`` documents lose all their lines but those of the
largest id that holds them.

How (DataFrame functions only): each document's line hashes (128 bits) are taken once, in a batch of ids each. A batch
counts its keys (which combines before the shuffle, so a common line is no hot key), drops by a sort-merge anti-join
those that a run settles already (found in LEAST_DOCS documents, a larger id among them), and writes the rest as a run of
its own, bucketed and sorted by hash: the joins shuffle no run. Of a level, FANOUT (two) runs are merged into one of the next by
an outer merge join, which shuffles neither.
Batches go from the largest ids down, so that most of what is common is settled early; any order gives the same result.
At the end the runs' sums tell which keys go, their places are joined to the documents that hold them, and each text is
put together without them: places and texts meet by id and digest, which shuffles the texts once, at every size alike.

Defined cases: a row is a document, rows of one id too; those that share the largest id all keep the line. Null ids
are smaller than all others, and null texts are one empty line. Repeated lines of a document count once and go together.
Texts without a dropped line come back as they are. An empty table gives an empty one; other columns are carried along, but for
n_lines and n_dropped, which are set.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.llm.common import bounded, fresh_path, let, text_or_empty
from chronoreel.llm.ranges import same

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 6, 2
#: A table of the common lines of up to so many bytes, measured, is broadcast; else its join, which adaptive execution can split, shuffles hashes.
SMALL = 8 << 20

_ENDS = " \t\n\x0b\x0c\r"


def line_hashes(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """For each line 128 bits of its key's md5 as 22 characters, or null if the key is short."""
    keys = F.transform(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), "\n"), lambda x: F.btrim(x, F.lit(_ENDS)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, F.substring(F.base64(F.unhex(F.md5(k.cast("binary")))), 1, 22)))


class LineRuns:
    """Runs of (h, n, top): a key's hash, documents counted and the largest id among them, in levels."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, least_docs: int = LEAST_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.log: list[tuple[str, int]] = []
        atexit.register(self.drop)

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.repartition(self.buckets, "h")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", fresh_path(self.spark, f"line-run-{level}")).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.log.append((f"level {level}", self.spark.table(name).count()))
        return name

    def _drop(self, names: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            for file in self.spark.table(name).inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Delete all runs."""
        with contextlib.suppress(Exception):  # the session may have gone first
            self._drop([x for level in self.levels for x in level])
        self.levels = []
        atexit.unregister(self.drop)

    def unsettled(self, fresh: DataFrame) -> DataFrame:
        """Keys of a batch (h, n, top) that no run has in enough documents with an id as large."""
        for name in [x for level in self.levels for x in level]:
            run = self.spark.table(name).where(F.col("n") >= self.least_docs).select(F.col("h").alias("__h"), F.col("top").alias("__top"))
            known = (F.col("h") == F.col("__h")) & (F.col("top").isNull() | F.coalesce(F.col("__top") >= F.col("top"), F.lit(False)))
            fresh = fresh.join(run.hint("merge"), known, "left_anti")
        return fresh

    def add(self, batch: DataFrame) -> None:
        """One batch of documents: (doc_id, hashes). No document may be in two batches."""
        lines = batch.select("doc_id", F.explode(F.array_distinct("hashes")).alias("h")).where(F.col("h").isNotNull())
        fresh = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        self._write(self.unsettled(fresh), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self._merged(old), level + 1)
            self.levels[level] = []
            self._drop(old)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """One run of several: outer merge joins, of which the first shuffles nothing as both sides are bucketed."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select(F.col("h").alias("__h"), F.col("n").alias("__n"), F.col("top").alias("__top"))
            both = rows.join(more.hint("merge"), F.col("h") == F.col("__h"), "full_outer")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))
            rows = both.select(F.coalesce("h", "__h").alias("h"), n.cast("long").alias("n"), F.greatest("top", "__top").alias("top"))
        return rows

    def common(self) -> DataFrame:
        """(h, top): keys found in enough documents, and the largest id that holds each."""
        names = [x for level in self.levels for x in level]
        return self._merged(names).where(F.col("n") >= self.least_docs).select("h", "top")


def _batches(docs: DataFrame, n: int) -> Column:
    """The number of a row's batch: 0 for the largest ids, about as many rows each; null ids are in the last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000)).first()[0] or []
    out = F.lit(0)
    for cut in sorted(set(cuts)):
        out = out + (F.col("doc_id") <= cut).cast("int")
    return F.when(F.col("doc_id").isNull(), F.lit(len(set(cuts)))).otherwise(out)


def _row_key(text_col: str) -> Column:
    return F.md5(text_or_empty(text_col).cast("binary"))


def dropped_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, digest, places): for each id and text that loses lines their numbers, from 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    number = _batches(rows.select("doc_id"), batches)
    hashed = rows.select(number.alias("batch"), "doc_id", _row_key("text").alias("digest"), line_hashes(text_or_empty("text"), least_chars).alias("hashes"))
    hashed = hashed.where(F.exists("hashes", lambda h: h.isNotNull()))
    path = fresh_path(spark, "line-hashes")
    hashed.write.partitionBy("batch").parquet(path)
    schema = "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", digest string, hashes array<string>, batch int"
    kept = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, least_docs=least_docs, fanout=fanout)
    for i in range(batches):
        runs.add(kept.where(F.col("batch") == i))
    common = bounded(runs.common(), "common-lines", SMALL)
    runs.drop()
    lines = kept.select("doc_id", "digest", F.posexplode("hashes").alias("place", "h")).where(F.col("h").isNotNull())
    lost = lines.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return lost.groupBy("doc_id", "digest").agg(F.collect_set("place").alias("places"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that go; adds n_lines (before) and n_dropped. Texts that lose nothing stay as they are."""
    places = dropped_places(docs, id_col, text_col, **options).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("places").alias("__places"))
    rows = docs.withColumns({"__id": F.col(id_col), "__digest": _row_key(text_col)})
    found = same(rows, places, ["__id", "__digest"], "left").drop("__id", "__digest")
    found = found.withColumn("n_lines", (F.length(text_or_empty(text_col)) - F.length(F.replace(text_or_empty(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long"))
    found = found.withColumn("n_dropped", F.coalesce(F.array_size("__places"), F.lit(0)).cast("long"))

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.array_size(lines) - 1), F.col("__places"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(let(F.split(text_or_empty(text_col), "\n"), rest))
    return found.withColumn(text_col, text).drop("__places")


def measure(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256, the digest of what stays."""
    out = clean(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


#: DuckDB form of ``measure``.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.top AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r"""
