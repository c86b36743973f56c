"""A scaled vector of eleven figures per document, its distance between documents, and the full figure set behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.config import Normalizer
from lexarium.functions import batch
from lexarium.operators import compare, entropy, lexical, sequential

# Each part's scale (None: taken as it is), the value that stands for null, and its weight in a distance.
PARTS = {
    "mtld": (500.0, 0.0, 2.0),
    "yules_k": (200.0, 0.0, 1.5),
    "burst_parameter": (None, 0.0, 2.0),
    "memory": (None, 0.0, 1.5),
    "mattr": (None, 0.5, 1.0),
    "hdd": (None, 0.5, 1.0),
    "letter_bigram_conditional": (4.0, 0.0, 1.0),
    "pattern_entropy": (10.0, 0.0, 1.2),
    "avg_sentence_length": (30.0, 0.0, 0.8),
    "avg_syllables": (4.0, 2.0, 0.8),
    "compression_ratio": (None, 0.5, 0.5),
}


def all_metrics(docs: DataFrame, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text", ordered: tuple[str, ...] = tuple(sequential.FIELDS)) -> DataFrame:
    """Every figure of every document: letters, words (window 100, words of 5 occurrences), readability and the ordered ones."""
    how = how or Normalizer()
    frame = entropy.letter_frame(docs, how, id_col, text_col)
    out = frame.select(id_col, "n_words", *[v.alias(k) for k, v in entropy.letter_metrics(how.size).items()])
    rows = lexical.token_rows(docs, how, id_col, text_col)
    gaps = lexical.gaps(rows, id_col)
    for part in (
        lexical.richness(rows, id_col).drop("n_tokens"),
        lexical.mattr(rows, 100, id_col),
        lexical.gries_mean(docs, 10, 5, how, id_col, text_col),
        lexical.burstiness_index(gaps, 5, id_col),
        lexical.burst_parameters(gaps, 5, id_col),
        lexical.syllable_entropy(docs, how, id_col, text_col).withColumnRenamed("conditional_entropy", "syllable_conditional"),
        lexical.ngram_distribution(docs, 2, "letter", how, id_col, text_col).select(id_col, F.col("conditional_entropy").alias("letter_bigram_conditional")),
        lexical.readability(docs, how, id_col, text_col),
        sequential.ordered_metrics(docs, ordered, how, id_col, text_col),
    ):
        out = out.join(part, id_col, "left")
    return out


def parts(docs: DataFrame, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the columns of PARTS alone, in one Arrow pass without a shuffle: what scaled() and vector() need of all_metrics()."""
    how = how or Normalizer()
    source = docs.select(id_col, batch.source(F.col(text_col), how).alias("own_words"), F.col(text_col).alias("own_text"))
    made = runtime.map_texts(source, "own_words", batch.ATTRIBUTION, lambda texts, raw: batch.attribution(texts, raw, how), also="own_text")
    return made.select(id_col, *PARTS)


def scaled() -> dict[str, Column]:
    """Each part scaled to at most 1, over the columns of all_metrics()."""
    value = {k: F.coalesce(F.col(k), F.lit(missing)) for k, (_, missing, _) in PARTS.items()}
    return {k: F.least(F.lit(1.0), value[k] / scale) if scale else value[k] for k, (scale, _, _) in PARTS.items()}


def vector(metrics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, features): the scaled parts as one array, in the order of PARTS."""
    return metrics.select(id_col, F.array(*scaled().values()).alias("features"))


def distance(a: Column, b: Column) -> Column:
    return compare.attribution_distance(a, b, [w for _, _, w in PARTS.values()])
