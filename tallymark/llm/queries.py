"""Queries of this subpackage over the driver tables, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import (
    decontam,
    jaccard,
    langid,
    packing,
    pii,
    quality,
    search,
    secrets,
    suffixes,
    suffixtree,
    urls,
    warc,
    whitening,
)
from tallymark.llm.common import table

#: Vocabulary file of a public tokeniser; a parameter of the operators, never copied.
TOKENIZER = "byte_bpe_50k.json"
QUERIES = {}
CHECKS = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_id(table(spark, folder, "documents"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents"))


CHECKS["op2_quality_rules"] = quality.SQL


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit(table(spark, folder, "documents"), tokenizer_path())


@query
def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffixtree.lm_scores(table(spark, folder, "documents"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages"))


CHECKS["op5_warc"] = warc.SQL


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeats(table(spark, folder, "documents"))


@query
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_scan(table(spark, folder, "documents"))


CHECKS["op4_secret_scan"] = secrets.SQL


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_filter(table(spark, folder, "pages"))


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.embedding_whitening(table(spark, folder, "embeddings"))


@query
def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CHECKS["op13_ranked_search"] = search.SQL


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
