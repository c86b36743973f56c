"""Word-level figures.  Those over token rows partition documents by id once, and every count, window and summary after that stays in its partition; those over texts
take one Arrow pass without a shuffle, a row for each text (an id is one text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.config import Normalizer
from lexarium.functions import batch
from lexarium.functions import text as T


def token_rows(docs: DataFrame, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, n_tokens), partitioned by id."""
    how = how or Normalizer()
    t = docs.select(id_col, text_col).repartition(id_col).select(id_col, T.tokens(T.words(F.col(text_col), how), how).alias("tokens"))
    return t.select(id_col, F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("pos", "token"))


def item_counts(rows: DataFrame, item: str = "token", id_col: str = "doc_id") -> DataFrame:
    """(id, item, n, first position)."""
    return rows.groupBy(id_col, F.col(item).alias("item")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def richness(rows: DataFrame, id_col: str = "doc_id", draw: int = 42) -> DataFrame:
    """Types, type-token ratio, Yule's K, hapax share and HD-D (textbook form, 0 under ``draw`` tokens)."""
    counts = item_counts(rows, id_col=id_col)
    size = F.sum("n").over(Window.partitionBy(id_col)).cast("double")
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(draw - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (F.col("size") - F.col("n") - i)) / (F.col("size") - i))
    c = counts.withColumn("size", size).withColumn("hit", F.when(F.col("size") >= draw, (1 - miss) / draw).otherwise(0.0))
    n = F.sum("n").cast("double")
    return c.groupBy(id_col).agg(
        F.sum("n").cast("long").alias("n_tokens"),
        F.count("*").cast("long").alias("n_types"),
        (F.count("*") / n).alias("ttr"),
        (10000 * (F.sum(F.col("n") * F.col("n")) - n) / (n * n)).alias("yules_k"),
        (F.sum((F.col("n") == 1).cast("int")) / F.count("*")).alias("hapax_ratio"),
        F.sum("hit").alias("hdd"),
    )


def mattr(rows: DataFrame, window: int = 500, id_col: str = "doc_id") -> DataFrame:
    """Moving-average type-token ratio; the plain ratio where there are fewer tokens than the window.

    A token counts in the windows that hold it but not its previous occurrence, a number that follows from the two positions.
    """
    prev = F.coalesce(F.lag("pos").over(Window.partitionBy(id_col, "token").orderBy("pos")), F.lit(-1))
    w = F.least(F.lit(window), F.col("n_tokens"))
    low = F.greatest(F.col("prev") + 1, F.col("pos") - w + 1, F.lit(0))
    high = F.least(F.col("pos"), F.col("n_tokens") - w)
    new = F.greatest(F.lit(0), high - low + 1)
    out = rows.withColumn("prev", prev).groupBy(id_col).agg(F.sum(new).cast("double").alias("new"), F.max("n_tokens").alias("n"))
    w = F.least(F.lit(window), F.col("n"))
    return out.select(id_col, (F.col("new") / (w * (F.col("n") - w + 1))).alias("mattr"))


def _pass(docs: DataFrame, how: Normalizer | None, id_col: str, text_col: str, fields: str, kernel, *args) -> DataFrame:
    """(id, fields): a kernel of functions.batch over the texts."""
    how = how or Normalizer()
    source = docs.select(id_col, batch.source(F.col(text_col), how).alias("own_text"))
    return runtime.map_texts(source, "own_text", fields, lambda texts: kernel(texts, how, *args))


def ngram_distribution(docs: DataFrame, n: int, unit: str = "word", how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Totals, entropy, conditional entropy (last item given the others), hapax figures and coverage of the 10 and 50 most frequent n-grams of words or letters."""
    fields = "total bigint, unique bigint, entropy double, hapax_count bigint, hapax_ratio double, coverage_10 double, coverage_50 double, conditional_entropy double"
    return _pass(docs, how, id_col, text_col, fields, batch.distribution, n, unit)


def top_ngrams(docs: DataFrame, n: int, k: int, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k most frequent n-grams of words of each id (ties: the earlier), with frequency, rank and cumulative share."""
    return _pass(docs, how, id_col, text_col, "ngram string, count bigint, frequency double, rank int, cumulative double", batch.top_grams, n, k)


def gaps(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, pos, gap, n): distance to the word's previous occurrence, where there is one; n occurrences in all."""
    own = Window.partitionBy(id_col, "token")
    out = rows.select(id_col, "token", "pos", (F.col("pos") - F.lag("pos").over(own.orderBy("pos"))).alias("gap"), F.count("*").over(own).alias("n"), F.min("pos").over(own).alias("first_pos"))
    return out.where(F.col("gap").isNotNull())


def burstiness_index(gap_rows: DataFrame, least: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Mean of (sd - mean) / (sd + mean) of the gaps of words with ``least`` occurrences."""
    per = gap_rows.where(F.col("n") >= least).groupBy(id_col, "token").agg(F.stddev_samp("gap").alias("s"), F.avg("gap").alias("m"), F.count("*").alias("k")).where("k >= 2")
    return per.groupBy(id_col).agg(F.avg((F.col("s") - F.col("m")) / (F.col("s") + F.col("m"))).alias("burstiness"))


def burst_parameters(gap_rows: DataFrame, least: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Pooled over words of ``least`` occurrences: burstiness parameter (3 gaps at least), memory coefficient, and short gaps (under half the median)."""
    pooled = gap_rows.where(F.col("n") >= least)
    order = Window.partitionBy(id_col).orderBy("first_pos", "pos")
    p = pooled.select(id_col, F.col("gap").cast("double").alias("gap"), F.lead(F.col("gap").cast("double")).over(order).alias("next"), F.expr(f"percentile(gap, 0.5) OVER (PARTITION BY {id_col})").alias("mid"))
    s, m = F.stddev_samp("gap"), F.avg("gap")
    both = F.col("next").isNotNull()
    x, y = F.when(both, F.col("gap")), F.col("next")
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    short = F.sum((F.col("gap") < F.col("mid") / 2).cast("int"))
    return p.groupBy(id_col).agg(
        F.count("*").cast("long").alias("n_gaps"),
        F.when(F.count("*") >= 3, (s - m) / (s + m)).alias("burst_parameter"),
        F.when(F.count("*") >= 3, r).alias("memory"),
        short.cast("long").alias("burst_count"),
        (short / F.count("*")).alias("burst_ratio"),
    )


def gries(rows: DataFrame, segments: int = 10, least: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, token, dp, dp_norm): deviation of proportions over segments that differ by a token at most, the longer ones first."""
    n, k = F.col("n_tokens"), F.least(F.lit(segments), F.col("n_tokens"))
    short, long_ = F.floor(n / k), n % k
    edge = long_ * (short + 1)
    seg = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (short + 1))).otherwise(long_ + F.floor((F.col("pos") - edge) / F.greatest(short, F.lit(1))))
    part = F.when(F.col("seg") < long_, short + 1).otherwise(short)
    cells = rows.withColumn("seg", seg).groupBy(id_col, "token", "seg").agg(F.count("*").alias("v"), F.max("n_tokens").cast("long").alias("n_tokens"))
    all_ = F.sum("v").over(Window.partitionBy(id_col, "token"))
    cells = cells.withColumn("f", all_).withColumn("s", part)
    per = cells.groupBy(id_col, "token").agg(F.max("f").alias("f"), F.max("n_tokens").alias("n_tokens"), F.sum(F.abs(F.col("v") * F.col("n_tokens") - F.col("f") * F.col("s"))).alias("seen"), F.sum("s").alias("share"))
    # Whole numbers up to one division; segments without the word add their share.
    dp = (F.col("seen") + F.col("f") * (F.col("n_tokens") - F.col("share"))) / (2 * F.col("f") * F.col("n_tokens"))
    low = F.floor(F.col("n_tokens") / k) / F.col("n_tokens")
    norm = F.when(low < 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - dp / (1 - low)))).otherwise(1.0)
    return per.where(F.col("f") >= least).select(id_col, "token", F.col("f").cast("long").alias("n"), dp.alias("dp"), norm.alias("dp_norm"))


def gries_words(docs: DataFrame, segments: int = 10, least: int = 1, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gries() from the texts, in one Arrow pass."""
    return _pass(docs, how, id_col, text_col, "token string, n bigint, dp double, dp_norm double", batch.gries, segments, least)


def gries_mean(docs: DataFrame, segments: int = 10, least: int = 1, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gries): mean of dp_norm over the words of ``least`` occurrences, of ids that have any."""
    return _pass(docs, how, id_col, text_col, "gries double", batch.gries, segments, least, True)


def syllable_entropy(docs: DataFrame, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entropies of syllable counts, of the next count given one, and of vowel patterns; ids with 10 words or more."""
    return _pass(docs, how, id_col, text_col, "syllable_entropy double, conditional_entropy double, pattern_entropy double, unique_patterns bigint", batch.syllable_entropy)


def readability(docs: DataFrame, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences, Flesch's index in its Russian form and the fog index; zeros without words.  One Arrow pass, no shuffle."""
    how = how or Normalizer()
    source = docs.select(id_col, batch.source(F.col(text_col), how).alias("own_words"), F.col(text_col).alias("own_text"))
    t = runtime.map_texts(source, "own_words", "n_sentences bigint, n bigint, syllables double, hard double", lambda texts, raw: batch.readability(texts, raw, how), also="own_text")
    n = F.col("n").cast("double")
    asl, asw, hard = n / F.greatest(F.col("n_sentences"), F.lit(1)), F.col("syllables") / n, F.col("hard") / n
    some = lambda v: F.when(n > 0, v).otherwise(0.0)
    return t.select(id_col, "n_sentences", some(asl).alias("avg_sentence_length"), some(asw).alias("avg_syllables"), some(206.835 - 1.3 * asl - 60.1 * asw).alias("flesch"), some(0.4 * (asl + 100 * hard)).alias("fog"))


def rolling_entropy(docs: DataFrame, window: int, step: int = 1, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, entropy) over windows of the first letters of words; none where there are fewer words than the window."""
    return _pass(docs, how, id_col, text_col, "position int, entropy double", batch.rolling, window, step)
