"""The facade: documents in, metric tables out.  A list of documents is the unit; one text is the case of one row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.config import Normalizer
from lexarium.functions import text as T
from lexarium.operators import compare, entropy, lexical, sequential, stats
from lexarium.sources import files


class Analyzer:
    """``analyze`` keeps every document; figures that a text has too little for are null or the figure's own default."""

    def __init__(self, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text"):
        self.how, self.id, self.text = how or Normalizer(), id_col, text_col

    def analyze(self, docs: DataFrame, words: bool = True, ordered: tuple[str, ...] = ()) -> DataFrame:
        """Letter figures, on request word figures and figures that need order.  Only the asked groups are in the plan."""
        clean = docs.withColumn(self.text, T.strip(F.col(self.text)))
        frame = entropy.letter_frame(clean, self.how, self.id, self.text)
        some = F.col("n_letters") > 0
        m = entropy.letter_metrics(self.how.size)
        out = frame.select(self.id, "n_words", *[v.alias(k) for k, v in m.items()])
        out = out.select(self.id, "n_words", "n_letters", *[F.when(some, F.col(k)).alias(k) for k in m if k != "n_letters"])
        if words:
            rows = lexical.token_rows(clean, self.how, self.id, self.text)
            parts = [
                lexical.richness(rows, self.id).drop("n_tokens"),
                lexical.mattr(rows, 500, self.id),
                lexical.gries_mean(clean, 10, 3, self.how, self.id, self.text),
                lexical.burstiness_index(lexical.gaps(rows, self.id), 5, self.id),
                lexical.syllable_entropy(clean, self.how, self.id, self.text).withColumnRenamed("conditional_entropy", "syllable_conditional"),
                lexical.ngram_distribution(clean, 2, "word", self.how, self.id, self.text).select(self.id, F.col("conditional_entropy").alias("word_bigram_entropy")),
            ]
            for p in parts:
                out = out.join(p, self.id, "left")
            out = out.join(lexical.readability(clean, self.how, self.id, self.text), self.id, "left")
        if ordered:
            out = out.join(sequential.ordered_metrics(clean, ordered, self.how, self.id, self.text), self.id, "left")
        return out

    def summary(self, metrics: DataFrame) -> DataFrame:
        """One row over all documents with an entropy: its distribution, and how it goes with the number of words."""
        h = metrics.where(F.col("entropy").isNotNull())
        return h.agg(*stats.extended_stats("entropy"), *stats.correlation("n_words", "entropy"))

    def outliers(self, metrics: DataFrame, method: str = "iqr", threshold: float | None = None) -> DataFrame:
        return stats.outliers(metrics.where(F.col("entropy").isNotNull()), "entropy", method, threshold)

    def directory(self, spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
        texts = files.read_texts(spark, path, pattern, recursive, fallback=False)
        return Analyzer(self.how, "path", "text").analyze(texts)

    def split(self, docs: DataFrame, delimiter: str = "***", least_words: int = 10) -> DataFrame:
        parts = files.split_segments(docs, delimiter, least_words, self.how, self.text, keep=(self.id,))
        return Analyzer(self.how, "segment_id", "text").analyze(parts.withColumn("segment_id", F.concat_ws("/", F.col(self.id).cast("string"), "name")))

    def compare(self, docs: DataFrame) -> DataFrame:
        """Distances of the letter distributions of each two documents; meant for a bounded number of texts."""
        p = compare.pairs(entropy.letter_frame(docs, self.how, self.id, self.text), self.id)
        empty = (F.aggregate("p", F.lit(0.0), lambda a, x: a + x) == 0) | (F.aggregate("q", F.lit(0.0), lambda a, x: a + x) == 0)
        fixed = {"kl_ab": math.inf, "kl_ba": math.inf, "js": 1.0, "cosine": 0.0}
        d = compare.distances(F.col("p"), F.col("q"))
        return p.select("a", "b", *[(F.when(empty, F.lit(fixed[k])).otherwise(v) if k in fixed else v).alias(k) for k, v in d.items()])

    def rolling(self, docs: DataFrame, window: int = 50, step: int = 10) -> DataFrame:
        return lexical.rolling_entropy(docs, window, step, self.how, self.id, self.text)
