"""Figures of a count distribution.  Counts are an array per row, so each figure is a fold inside the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.config import Normalizer
from lexarium.functions import batch


def total(counts: Column, f=lambda n: n) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + f(n).cast("double"))


def shannon(counts: Column, base: float = 2.0) -> Column:
    """log N - sum n log n / N; 0 without counts."""
    n = total(counts)
    nlogn = total(counts, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return F.when(n > 0, (F.log2(n) - nlogn / n) / math.log2(base)).otherwise(0.0)


def miller_madow(h: Column, kinds: Column, n: Column) -> Column:
    """h + (K - 1) / 2N, unchanged without counts; the correction is in nats whatever the unit of h."""
    return F.when(n > 0, h + (kinds - 1) / (2 * n)).otherwise(h)


def renyi(counts: Column, order: float) -> Column:
    n = total(counts)
    if order == 0:
        out = F.log2(total(counts, lambda x: (x > 0).cast("int")))
    elif order == 1:
        return shannon(counts)
    elif math.isinf(order):
        out = -F.log2(F.array_max(counts) / n)
    else:
        out = F.log2(total(counts, lambda x: F.when(x > 0, F.pow(x, F.lit(float(order)))).otherwise(0.0)) / F.pow(n, F.lit(float(order)))) / (1 - order)
    return F.when(n > 0, out).otherwise(0.0)


def letter_frame(docs: DataFrame, how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words and counts aligned with the alphabet, in one Arrow pass; nulls for a null text."""
    how = how or Normalizer()
    source = docs.select(id_col, *keep, batch.source(F.col(text_col), how).alias("own_text"))
    return runtime.map_texts(source, "own_text", "n_words bigint, counts array<int>", lambda texts: batch.letter_figures(texts, how))


def letter_metrics(alphabet_size: int, counts: str = "counts", n_words: str = "n_words") -> dict[str, Column]:
    """All figures of the letter distribution by name; none divides by zero."""
    c = F.col(counts)
    n = total(c)
    kinds = total(c, lambda x: (x > 0).cast("int"))
    h = shannon(c)
    some = lambda v, other=0.0: F.when(n > 0, v).otherwise(F.lit(other))
    sq = total(c, lambda x: x * x)
    ranks = F.transform(c, lambda x, i: x * (i + 1))
    ranks2 = F.transform(c, lambda x, i: x * (i + 1) * (i + 1))
    mean_rank = some(total(ranks) / n)
    size = float(alphabet_size)
    even = 1.0 / alphabet_size
    simpson = F.when(n > 1, total(c, lambda x: x * (x - 1)) / (n * (n - 1))).otherwise(1.0)
    p = lambda x: x / n
    return {
        "n_letters": n.cast("long"),
        "n_kinds": kinds.cast("long"),
        "entropy": h,
        "entropy_miller_madow": miller_madow(h, kinds, n),
        "entropy_normalized": h / math.log2(size) if size > 1 else F.lit(0.0),
        "entropy_per_word": some(h / n),
        "perplexity": F.pow(F.lit(2.0), h),
        "utilization": kinds / size,
        "herfindahl": some(sq / (n * n)),
        "uniform_euclidean": some(F.sqrt(total(c, lambda x: (p(x) - even) * (p(x) - even)))),
        "uniform_manhattan": some(total(c, lambda x: F.abs(p(x) - even))),
        "uniform_chebyshev": some(F.greatest(F.abs(F.array_max(c) / n - even), F.abs(F.array_min(c) / n - even))),
        "uniqueness": F.when(F.col(n_words) > 0, kinds / F.col(n_words)).otherwise(0.0),
        "redundancy": 1 - h / math.log2(size) if size > 1 else F.lit(0.0),
        "evenness": F.when(kinds > 1, h / F.log2(kinds)).otherwise(1.0),
        "renyi_0": renyi(c, 0),
        "renyi_2": renyi(c, 2),
        "renyi_inf": renyi(c, math.inf),
        "mean_rank": mean_rank,
        "std_rank": some(F.sqrt(F.greatest(total(ranks2) / n - mean_rank * mean_rank, F.lit(0.0)))),
        "simpson": simpson,
        "gini_simpson": 1 - simpson,
    }


def letter_stats(frame: DataFrame, how: Normalizer, id_col: str = "doc_id") -> DataFrame:
    """One row per document and letter of the alphabet: rank, letter, count, probability, p_log2."""
    letters = F.array(*[F.lit(c) for c in how.alphabet_letters])
    rows = frame.select(id_col, total(F.col("counts")).alias("n"), F.posexplode(F.arrays_zip(letters.alias("letter"), F.col("counts").alias("count"))).alias("pos", "x"))
    p = F.when(F.col("n") > 0, F.col("x.count") / F.col("n")).otherwise(0.0)
    return rows.select(id_col, (F.col("pos") + 1).alias("rank"), F.col("x.letter").alias("letter"), F.col("x.count").cast("long").alias("count"), p.alias("probability"), F.when(p > 0, p * F.log2(p)).otherwise(0.0).alias("p_log2"))


def entropy_of_groups(df: DataFrame, *by: str, count: str = "n") -> Column:
    """Aggregate expression: entropy in bits of the counts within a group."""
    n = F.sum(F.col(count)).cast("double")
    return F.when(n > 0, F.log2(n) - F.sum(F.when(F.col(count) > 0, F.col(count) * F.log2(count)).otherwise(0.0)) / n).otherwise(0.0)


def joint_entropy(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: entropies of x, y and both, mutual information and the conditional entropy of y given x; nulls count as a value.

    The pairs are counted once and the margins are summed from them.
    """
    pairs = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    sets = pairs.groupingSets([["x"], ["y"], ["x", "y"]], "x", "y").agg(F.sum("n").alias("n"), F.grouping_id("x", "y").alias("g"))
    h = sets.groupBy("g").agg(entropy_of_groups(sets).alias("h"))
    part = lambda k: F.coalesce(F.max(F.when(F.col("g") == k, F.col("h"))), F.lit(0.0))
    out = h.agg(part(1).alias("h_x"), part(2).alias("h_y"), part(0).alias("h_xy"))
    return out.withColumns({"mutual_information": F.greatest(F.col("h_x") + F.col("h_y") - F.col("h_xy"), F.lit(0.0)), "conditional_entropy": F.greatest(F.col("h_xy") - F.col("h_x"), F.lit(0.0))})


def zipf(counts: DataFrame, id_col: str = "doc_id", item: str = "item", n: str = "n") -> DataFrame:
    """Slope and fit of log frequency over log rank for the non-zero counts of each id; 0 for fewer than 3."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(n), item))
    ranked = counts.where(F.col(n) > 0).select(id_col, F.log(F.col(n).cast("double")).alias("y"), F.log(rank.cast("double")).alias("x"))
    return ranked.groupBy(id_col).agg(
        F.when(F.count("*") >= 3, -F.regr_slope("y", "x")).otherwise(0.0).alias("zipf_alpha"),
        F.when(F.count("*") >= 3, F.when(F.regr_syy("y", "x") == 0, 1.0).otherwise(F.regr_r2("y", "x"))).otherwise(0.0).alias("zipf_r2"),
    )
