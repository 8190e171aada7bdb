"""The queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoreel.llm import byte_cnn, html_text, line_dedup, maxent_lm, merkle, mixing, packing, prefix_trie, quality_rules, secrets, simhash, vectors, warc
from chronoreel.llm.common import table


def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build(spark, table(spark, sf_dir, "pages"))


def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, model=secrets.train(secrets.samples(docs)))


def op9_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.tampered_lines())


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.measure(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_links": op1_vector_links,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_length_packing": op4_length_packing,
    "op5_main_text": op5_main_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_byte_cnn_quality": op9_byte_cnn_quality,
    "op10_maxent_lm": op10_maxent_lm,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_vector_links": vectors.ORACLE,
    "op3_warc_revisits": warc.ORACLE,
    "op4_length_packing": packing.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_source_mix": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
