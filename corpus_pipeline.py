"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.llm import bpe
from slicelake.llm.mixing import domain_of_source, mix, mixed_documents, target_weights
from slicelake.llm.quality import quality_scores
from slicelake.llm.simhash import simhash_groups
from slicelake.llm.suffixes import kept_text
from slicelake.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Differing bits of 192 up to which texts are candidates: 29 is the mean at a Jaccard similarity of 0.8, with a deviation of 5, so about one such pair in 10,000 is none.
MAX_BITS = 48


def own_rows(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` by doc_id and hash of the text, with (semi) or without (anti) a row in ``chosen`` (doc_id, h)."""
    ids = chosen.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("h_"))
    return docs.select(*COLUMNS).join(ids, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; what it rejects goes.

    Rows are judged by their texts: a null text as an empty one, repeated rows alike, rows of one doc_id each by its
    own text. An empty table stays empty.
    """
    return own_rows(docs, quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1"), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Near copies have sets of five-word shingles with a Jaccard similarity of 0.8 or more, or are joined by a chain of such
    pairs. Candidates meet by fingerprints in the index of positional bytes and in lists of shingles, in MAX_BITS of 192 bits
    or fewer, and are verified by the sets themselves. Texts without words are near copies of one
    another, null ones too; rows without a doc_id stay; of rows with one doc_id and text the least (lang, source) stays.
    """
    groups = simhash_groups(docs, shingle=5, max_bits=MAX_BITS, words=3, match=4, least="0.8")
    return own_rows(docs, groups.where("doc_id <> component_id"), "left_anti").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("one")).select("doc_id", "text", "one.*").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that start in a document of a smaller doc_id too; n_chars follows. A character goes only if all its bytes go.

    A null text is empty, and stays as an empty one, as does a text of which nothing is left. Rows without a doc_id stay as
    they are; rows with one doc_id and text each stay, with the least (lang, source) of them; texts of any length are
    judged whole; an empty table stays empty.
    """
    names = F.min(F.struct("lang", "source")).alias("one")
    rest = docs.select(F.col("doc_id").alias("id_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h_"), "lang", "source").groupBy("id_", "h_").agg(names).select("id_", "h_", "one.*")
    joined = kept_text(docs, 50).join(rest, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
    return joined.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at target weights; a document stands once for each epoch that holds it.

    Null names are sources of their own; a null text has no tokens and stays in every epoch that its leaf reads whole;
    equal rows are chosen together. An empty table stays empty.
    """
    return mixed_documents(docs, mix(docs, domain_of_source(), target_weights(), share=0.9, epochs=2)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the token ids of each text, and the bytes that they decode to, as digests.

    A row for each row, repeated ones too; a null or empty text has no tokens. An empty table stays empty.
    """
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digest(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]
#: The first and third stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
