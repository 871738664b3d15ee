"""One query for each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.llm import bpe, mixing, negatives, search, spans, suffixes, urls
from slicelake.llm.common import table
from slicelake.llm.language import languages
from slicelake.llm.mixing import domain_of_source, mix, target_weights
from slicelake.llm.negatives import hard_negatives
from slicelake.llm.quality import quality_scores
from slicelake.llm.sampling import edited_fingerprints
from slicelake.llm.search import top_k
from slicelake.llm.simhash import simhash_groups
from slicelake.llm.spans import sentence_spans
from slicelake.llm.token_files import op10_rows
from slicelake.llm.urls import PATTERNS, RULES, filter_urls, rule_table
from slicelake.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4).drop("h")


@query
def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_of_source(), target_weights()).drop("h")


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"), 50)


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return op10_rows(table(spark, sf_dir, "documents"), f.read())


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES, PATTERNS))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op2_sentence_span_dedup"] = spans.SQL
ORACLES["op6_source_mixing"] = mixing.SQL
ORACLES["op9_exact_top_k"] = search.SQL
ORACLES["op13_url_filters"] = urls.SQL
ORACLES["op11_hard_negatives"] = negatives.SQL
