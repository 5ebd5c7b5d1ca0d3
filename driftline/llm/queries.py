"""One query for each operator, with the parameters of production, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm import sql, urls
from driftline.llm.common import Scratch, table

VOCABULARY = "word_bpe_49k.json"
RULES = [
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
]


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_adaptive_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.jaccard import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"), size=4, threshold=Fraction(85, 100)).drop("class_id")


def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.codec import read_digests, write_store

    path = Scratch(spark, "ids").path("store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return read_digests(spark, path)


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.search import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 20 = 0"))


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_harmonic_packing, op2_adaptive_jaccard_join, op3_toxicity_trees, op4_huffman_ids, op5_host_suffix_array, op6_host_reputation, op7_qgram_decontamination, op8_subword_quality, op9_bootstrapped_pii, op10_adaptive_scan)}

ORACLE_SQL: dict[str, str] = {
    "op2_adaptive_jaccard_join": sql.similarity_components(4, 85),
    "op5_host_suffix_array": sql.articles(),
    "op6_host_reputation": urls.sql(RULES),
    "op9_bootstrapped_pii": sql.personal_data(),
}
