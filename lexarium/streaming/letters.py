"""Incremental letter counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.config import Normalizer
from lexarium.operators.entropy import letter_frame, shannon


def running_letter_counts(stream: DataFrame, how: Normalizer | None = None, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """Counts of each letter by label; one state row per label, so state doesn't grow with the stream.  Write it in complete or update mode."""
    how = how or Normalizer()
    frame = letter_frame(stream, how, label_col, text_col)
    sums = frame.groupBy(label_col).agg(*[F.sum(F.get("counts", F.lit(i))).alias(c) for i, c in enumerate(how.alphabet_letters)])
    return sums.withColumn("entropy", shannon(F.array(*[F.col(c) for c in how.alphabet_letters])))


def windowed_letter_counts(stream: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes", how: Normalizer | None = None, text_col: str = "text") -> DataFrame:
    """Entropy of the letters of each event-time window; windows close once the watermark passes them."""
    how = how or Normalizer()
    timed = letter_frame(stream.withWatermark(time_col, late), how, time_col, text_col)
    sums = timed.groupBy(F.window(time_col, window)).agg(*[F.sum(F.get("counts", F.lit(i))).alias(c) for i, c in enumerate(how.alphabet_letters)])
    return sums.select("window", shannon(F.array(*[F.col(c) for c in how.alphabet_letters])).alias("entropy"))
