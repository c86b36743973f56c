"""The registered query of each operator: whole tables, production parameters, the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, embedding_dedup, language_id, lm_score, ngram_join, substring_dedup, token_counts, toxicity, warc
from ._spark import crc_part, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_part("doc_id", 3) == 1
    net = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, net, held_out=held_out)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_part("doc_id", 7) == 2
    return lm_score.score(table(spark, sf_dir, "documents"), ~held_out, held_out=held_out)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "linked_id", "target_uri", "warc_date", "content_type", "block", "source_digest", "block_digest", "content_length")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_part("doc_id", 4) == 2
    crf = toxicity.train(docs, labels.where(~held_out))
    out = toxicity.score(docs, crf, held_out=held_out)
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_byte_bpe, op3_embedding_dedup, op4_substring_dedup, op5_decontamination, op6_token_counts, op7_lm_score, op8_warc, op9_ngram_jaccard, op10_toxicity)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": embedding_dedup.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op5_decontamination": decontamination.ORACLE, "op8_warc": warc.ORACLE, "op9_ngram_jaccard": ngram_join.ORACLE}
