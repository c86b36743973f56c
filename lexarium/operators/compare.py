"""Distances between distributions held as aligned arrays, one pair per row, and Delta distances over word frequencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.operators.entropy import total


def probabilities(counts: Column) -> Column:
    n = total(counts)
    return F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def _fold(p: Column, q: Column, f) -> Column:
    return F.aggregate(F.zip_with(p, q, f), F.lit(0.0), lambda a, x: a + x)


def kl(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Divergence of p from q in bits; q is smoothed and normalised again."""
    norm = F.aggregate(q, F.lit(0.0), lambda a, x: a + x + eps)
    return _fold(p, q, lambda x, y: F.when(x > 0, x * F.log2(x / ((y + eps) / norm))).otherwise(0.0))


def js(p: Column, q: Column) -> Column:
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return F.greatest(0.5 * _fold(p, q, half) + 0.5 * _fold(q, p, half), F.lit(0.0))


def cosine(p: Column, q: Column) -> Column:
    norm = F.sqrt(_fold(p, p, lambda x, y: x * y)) * F.sqrt(_fold(q, q, lambda x, y: x * y))
    return F.when(norm > 0, _fold(p, q, lambda x, y: x * y) / norm).otherwise(0.0)


def information_distances(p: Column, q: Column) -> dict[str, Column]:
    bc = _fold(p, q, lambda x, y: F.sqrt(x * y))
    steps = F.aggregate(F.zip_with(p, q, lambda x, y: x - y), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda a, d: F.struct((a["c"] + d).alias("c"), (a["s"] + F.abs(a["c"] + d)).alias("s")), lambda a: a["s"])
    return {
        "wasserstein": steps,
        "hellinger": F.sqrt(F.greatest(1 - bc, F.lit(0.0))),
        "bhattacharyya": F.when(bc > 0, -F.log(bc)).otherwise(F.lit(math.inf)),
        "total_variation": 0.5 * _fold(p, q, lambda x, y: F.abs(x - y)),
    }


def distances(p: Column, q: Column) -> dict[str, Column]:
    return {"kl_ab": kl(p, q), "kl_ba": kl(q, p), "js": js(p, q), "cosine": cosine(p, q), **information_distances(p, q)}


def pairs(frame: DataFrame, id_col: str, counts: str = "counts") -> DataFrame:
    """Rows (a, b, p, q) for each two groups a < b.  Meant for a bounded number of groups such as authors."""
    side = lambda s, v: frame.select(F.col(id_col).alias(s), probabilities(F.col(counts)).alias(v))
    return side("a", "p").join(side("b", "q"), F.col("a") < F.col("b"))


def group_letters(frame: DataFrame, group: str, size: int) -> DataFrame:
    """Letter counts of each group, from the documents' arrays: one sum per letter, summed before the shuffle."""
    sums = frame.groupBy(group).agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(size)])
    return sums.select(group, F.array(*[F.col(f"n{i}") for i in range(size)]).alias("counts"))


def mfw_frequencies(counts: DataFrame, group: str, limit: int = 100) -> DataFrame:
    """(group, item, rank, f): relative frequencies of the most frequent items of all groups together (ties by item)."""
    all_ = counts.groupBy("item").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "item").limit(limit)
    top = all_.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("all"), "item")))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    cells = F.broadcast(top).crossJoin(sizes)
    return cells.join(counts.select(group, "item", "n"), [group, "item"], "left").select(group, "item", "rank", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("f"))


def z_scores(freq: DataFrame) -> DataFrame:
    """Standard scores of each item over the groups; a deviation of 0 counts as 1."""
    w = Window.partitionBy("item")
    s = F.stddev_samp("f").over(w)
    return freq.withColumn("z", (F.col("f") - F.avg("f").over(w)) / F.when(s > 0, s).otherwise(1.0))


def deltas(z: DataFrame, group: str) -> DataFrame:
    """(a, b, burrows, eder, cosine_delta) for each two groups."""
    n = F.count("*").cast("double")
    b = z.select(F.col(group).alias("b"), F.col("item").alias("item_b"), F.col("z").alias("zb"))
    j = z.select(F.col(group).alias("a"), "item", "rank", F.col("z").alias("za")).join(b, (F.col("item") == F.col("item_b")) & (F.col("a") < F.col("b")))
    size = F.count("*").over(Window.partitionBy("a", "b"))
    j = j.withColumn("w", 1 - F.col("rank") / (size + 1))
    d = F.abs(F.col("za") - F.col("zb"))
    norm = F.sqrt(F.sum(F.col("za") * F.col("za"))) * F.sqrt(F.sum(F.col("zb") * F.col("zb")))
    return j.groupBy("a", "b").agg((F.sum(d) / n).alias("burrows"), F.sum(d * F.col("w")).alias("eder"), F.when(norm > 0, 1 - F.sum(F.col("za") * F.col("zb")) / norm).alias("cosine_delta"))


def compare_ngrams(counts: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """One row: shared and unique n-grams of two groups, Jaccard, JS in bits and cosine, from a full outer join."""
    side = lambda g, n: counts.where(F.col(group) == g).select("item", F.col("n").alias(n))
    j = side(a, "na").join(side(b, "nb"), "item", "full_outer")
    ta, tb = counts.where(F.col(group) == a).agg(F.sum("n").alias("ta")), counts.where(F.col(group) == b).agg(F.sum("n").alias("tb"))
    f = j.crossJoin(F.broadcast(ta)).crossJoin(F.broadcast(tb)).select(F.coalesce(F.col("na") / F.col("ta"), F.lit(0.0)).alias("p"), F.coalesce(F.col("nb") / F.col("tb"), F.lit(0.0)).alias("q"))
    half = lambda x, y: F.when(F.col(x) > 0, F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    both = F.sum(((F.col("p") > 0) & (F.col("q") > 0)).cast("int"))
    return f.agg(
        both.cast("long").alias("shared"),
        F.sum((F.col("q") == 0).cast("int")).cast("long").alias("only_a"),
        F.sum((F.col("p") == 0).cast("int")).cast("long").alias("only_b"),
        (both / F.count("*")).alias("jaccard"),
        (0.5 * F.sum(half("p", "q")) + 0.5 * F.sum(half("q", "p"))).alias("js"),
        (F.sum(F.col("p") * F.col("q")) / (F.sqrt(F.sum(F.col("p") * F.col("p"))) * F.sqrt(F.sum(F.col("q") * F.col("q"))))).alias("cosine"),
    )


def differing_ngrams(counts: DataFrame, group: str, a: str, b: str, k: int = 10, least: int = 3) -> DataFrame:
    """The k n-grams most over-represented in ``a``: (f1 - f2) / max(f2, 1e-4), of ``least`` occurrences there; ties by n-gram."""
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    f = counts.join(F.broadcast(sizes), group).select(group, "item", "n", (F.col("n") / F.col("size")).alias("f"))
    one = f.where((F.col(group) == a) & (F.col("n") >= least)).select("item", "n", F.col("f").alias("f1"))
    two = f.where(F.col(group) == b).select("item", F.col("f").alias("f2"))
    j = one.join(two, "item", "left").withColumn("f2", F.coalesce("f2", F.lit(0.0)))
    score = (F.col("f1") - F.col("f2")) / F.greatest(F.col("f2"), F.lit(1e-4))
    return j.select("item", F.col("n").cast("long").alias("n"), "f1", "f2", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "item").limit(k)


def attribution_distance(a: Column, b: Column, weights: list[float] | None = None, size: int = 11) -> Column:
    """Weighted Euclidean distance of two feature vectors: sqrt(sum w d^2 / sum w)."""
    w = weights or [1.0] * size
    d = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / float(sum(w)))
