"""From raw documents to batches: quality, near-copies, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and read
again as the docs of the next stage. All stages but the last return the columns of ``documents``.

Defined cases: rows without an id are judged like any other by quality, never removed as copies, and mixed
and packed on their own; null texts count as empty; an empty table passes as an empty table; columns beyond
those of ``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.llm import byte_cnn, mixing, near_copies, packing, secrets
from chronoreel.llm.common import dropped, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts; it learns from the labelled ones among ``docs``."""
    return byte_cnn.accepted(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars to match."""
    out = secrets.redact(docs, model=secrets.train(secrets.samples(docs)))
    same = F.col("text").isNull() | ~F.contains(F.col("text"), F.lit("[SECRET]"))
    return out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: never, once, twice or three times."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch for each document of the mix."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: A trained network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Of the tables between them, each goes when the next is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
