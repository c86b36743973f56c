"""A corpus pipeline of five stages, each one of the library's corpus operators over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.  All but the last return the
columns of ``documents``, in their order, extra ones included.  A stage looks at ``text`` and ``doc_id`` only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import byte_bpe, decontamination, ngram_join, substring_dedup, toxicity
from lexarium.llm._spark import Cuts, crc_part, free_name, prepare, table

#: Scores from here on reject a document.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores under TOXIC.  It learns from the labels of documents outside the held-out quarter."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(crc_part("doc_id", 4) != 2)
    crf = toxicity.train(docs, labels)
    names = [f"c{k}" for k in range(len(docs.columns))]
    columns = {n: F.col(f"`{c}`") for n, c in zip(names, docs.columns, strict=True)}
    row_id = free_name(docs, "row_id")
    scored = toxicity.score(docs.withColumn(row_id, F.lit(None).cast("int")), crf, id_col=row_id, **columns)
    return scored.where(F.col("score") < TOXIC).select(*names).toDF(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by shingle similarity."""
    prepare(spark)
    return ngram_join.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word passages that a smaller document has; documents that lose all their words go."""
    prepare(spark)
    return substring_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of fewer than two benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text."""
    prepare(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_similar),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the random field nor byte-pair merges.  The operators have brute-force tests of their own; the chain of stages has none yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    cuts = Cuts(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = cuts.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
