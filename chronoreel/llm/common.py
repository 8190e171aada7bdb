"""What the corpus operators share: tables, the shared work folder, words, crc32 folds."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII control characters.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session has none (tests in local mode) is a temporary one made, and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="chronoreel-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders of applications whose work files are to go when the driver ends.
_registered: set[str] = set()


def clean(spark: SparkSession) -> None:
    """Delete all work files of this application; results that were not written elsewhere go with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's work files, below the shared folder. It is deleted when the driver ends."""
    found = f"{shared_dir(spark).rstrip('/')}/chronoreel/{spark.sparkContext.applicationId}"
    if found not in _registered:
        _registered.add(found)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(found)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def remove() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                files.delete(path, True)

        atexit.register(remove)
    return found


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path among the work files, with its file system named, for readers and writers outside Spark too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, tag: str, most_bytes: int = 8 << 20) -> DataFrame:
    """``df`` stored, and marked for broadcast if its measured size allows; else joins shuffle it."""
    kept = stored(df, tag)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in kept.dtypes if kind in ("string", "binary")]
    size = kept.agg(F.sum(sum(texts, F.lit(16 * len(kept.columns)))).alias("b")).first()["b"] or 0
    return F.broadcast(kept) if size <= most_bytes else kept


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def word_count(text: Column) -> Column:
    """Number of words, without keeping them."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable, never copied into inner lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_sql(column: str) -> str:
    """DuckDB form of the unsigned crc32 (polynomial 0xEDB88320) of an id as text; a null id counts as the empty text."""
    digits = f"list_transform(range(length(coalesce({column}::VARCHAR, ''))), lambda i: ascii(substr({column}::VARCHAR, (i + 1)::INT, 1))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda x, b: {bits}), 4294967295)"
