"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import (
    ann, bpe, divergence, filteraudit, jaccard, langid, mixing, quality, secrets, sharding, sql, tokencounts, urlfilter, vectordups,
)
from tenure.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, learn=langid.remainder("doc_id") != 1)
    return found.select("doc_id", (langid.remainder("doc_id") == 1).alias("held_out"), "lang_pred", "score", "bits", "rejected")


#: The vocabulary of the registered queries; any rank file with its pattern will do.
RANKS, PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencounts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), PATTERN, rule="first")
    return counts.select("doc_id", F.col("section").cast("int").alias("line"), "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_query(spark, table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordups.link(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "words", "perplexity", "limit", "kept")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality": op9_quality,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": sql.URL_FILTER,
    "op7_mixing": sql.MIXING,
    "op11_source_divergence": sql.SOURCE_DIVERGENCE,
    "op12_filter_audit": sql.FILTER_AUDIT,
    "op13_secret_scan": sql.SECRET_SCAN,
}
