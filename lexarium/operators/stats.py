"""Summaries, outliers, group comparisons and multiple-test corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extended_stats(v: str) -> list[Column]:
    """Aggregates: null for fewer than two values.  Skewness and kurtosis are bias-corrected."""
    n = F.count(v).cast("double")
    ok = lambda c: F.when(F.count(v) >= 2, c)
    g1, g2 = F.skewness(v), F.kurtosis(v)
    mean, sd = F.avg(v), F.stddev_samp(v)
    q1, q3 = F.percentile(v, F.lit(0.25)), F.percentile(v, F.lit(0.75))
    return [
        F.count(v).alias("n"),
        ok(mean).alias("mean"),
        ok(F.median(v)).alias("median"),
        ok(sd).alias("std"),
        ok(F.var_samp(v)).alias("variance"),
        ok(q1).alias("q1"),
        ok(q3).alias("q3"),
        ok(q3 - q1).alias("iqr"),
        ok(F.when(F.abs(mean) > 1e-10, 100 * sd / F.abs(mean)).otherwise(0.0)).alias("cv_percent"),
        F.when(F.count(v) >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skewness"),
        F.when(F.count(v) >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        ok(F.min(v)).alias("min"),
        ok(F.max(v)).alias("max"),
    ]


def correlation(x: str, y: str) -> list[Column]:
    """r, slope, intercept and r squared; null for fewer than two rows or a constant."""
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return [r.alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (r * r).alias("r_squared")]


def mad(df: DataFrame, v: str, *by: str) -> DataFrame:
    """Median absolute deviation per group; one pass for the median, one for the deviations."""
    own = F.expr(f"percentile({v}, 0.5) OVER (PARTITION BY {', '.join(by) or '0'})")
    return df.withColumn("own_mid", own).groupBy(*by).agg(F.percentile(F.abs(F.col(v) - F.col("own_mid")), F.lit(0.5)).alias("mad"))


def outliers(df: DataFrame, v: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """``df`` with ``score`` and ``is_outlier``; with fewer than three values none is one.  A threshold of 0 means the default."""
    if method not in ("iqr", "zscore", "modified_zscore"):
        raise ValueError(f"unknown method {method!r}")
    limit = threshold or {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5}[method]
    s = df.agg(F.count(v).alias("o_n"), F.avg(v).alias("o_mean"), F.stddev_samp(v).alias("o_sd"), F.percentile(v, F.lit(0.25)).alias("o_q1"), F.percentile(v, F.lit(0.5)).alias("o_mid"), F.percentile(v, F.lit(0.75)).alias("o_q3"))
    x = F.col(v)
    if method == "modified_zscore":
        one = df.crossJoin(F.broadcast(s))
        s = s.crossJoin(one.agg(F.percentile(F.abs(x - F.col("o_mid")), F.lit(0.5)).alias("o_mad")))
    iqr = F.col("o_q3") - F.col("o_q1")
    if method == "iqr":
        low, high = F.col("o_q1") - limit * iqr, F.col("o_q3") + limit * iqr
        out = (x < low) | (x > high)
        score = F.when(~out | (iqr == 0), 0.0).when(x < low, (low - x) / iqr).otherwise((x - high) / iqr)
    elif method == "zscore":
        score = F.when(F.col("o_sd") < 1e-10, 0.0).otherwise(F.abs(x - F.col("o_mean")) / F.nullif(F.col("o_sd"), F.lit(0.0)))
        out = score > limit
    else:
        score = F.when(F.col("o_mad") < 1e-10, 0.0).otherwise(0.6745 * F.abs(x - F.col("o_mid")) / F.nullif(F.col("o_mad"), F.lit(0.0)))
        out = score > limit
    return df.crossJoin(F.broadcast(s)).select(*df.columns, F.coalesce(score, F.lit(0.0)).alias("score"), (F.coalesce(out, F.lit(False)) & (F.col("o_n") >= 3)).alias("is_outlier"))


def cohens_d(df: DataFrame, group: str, v: str, a, b) -> DataFrame:
    """Cohen's d of group a against b with pooled deviation, and its size in words."""
    part = lambda g, f: f(F.when(F.col(group) == g, F.col(v)))
    s = df.agg(*[part(g, f).alias(f"{k}_{n}") for g, n in ((a, "a"), (b, "b")) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    free = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(((F.col("n_a") - 1) * F.coalesce("v_a", F.lit(0.0)) + (F.col("n_b") - 1) * F.coalesce("v_b", F.lit(0.0))) / F.nullif(free.cast("double"), F.lit(0.0)))
    d = F.when(free > 0, F.when(pooled > 0, (F.col("m_a") - F.col("m_b")) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)).otherwise(0.0)
    size = F.when(free <= 0, "undefined").when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")
    return s.select("n_a", "n_b", "m_a", "m_b", d.alias("cohens_d"), size.alias("effect"))


def rank_sum(df: DataFrame, group: str, v: str, a) -> DataFrame:
    """Mann-Whitney U of group a, with mid-ranks and the tie term for the normal approximation."""
    w = Window.orderBy(v)
    tied = df.groupBy(v).agg(F.count("*").alias("t"), F.sum((F.col(group) == a).cast("int")).alias("in_a"))
    before = F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = tied.withColumn("rank", before + (F.col("t") + 1) / 2)
    n1, n = F.sum("in_a"), F.sum("t")
    return r.agg((F.sum(F.col("rank") * F.col("in_a")) - n1 * (n1 + 1) / 2).alias("u"), n1.alias("n1"), (n - n1).alias("n2"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))


def correct_p_values(df: DataFrame, p: str, method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """``df`` with ``adjusted`` and ``significant``.  The number of tests is taken to be small."""
    if method not in ("bonferroni", "fdr_bh", "fdr_by"):
        raise ValueError(f"unknown method {method!r}")
    all_ = Window.partitionBy()
    n = F.count("*").over(all_)
    if method == "bonferroni":
        adjusted = F.least(F.lit(1.0), F.col(p) * n)
        out = df.withColumn("adjusted", adjusted)
    else:
        rank = F.row_number().over(all_.orderBy(p))
        harmonic = F.aggregate(F.sequence(F.lit(1), F.col("own_n").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i) if method == "fdr_by" else F.lit(1.0)
        t = df.withColumn("own_rank", rank).withColumn("own_n", n)
        t = t.withColumn("own_raw", F.col(p) * F.col("own_n") * harmonic / F.col("own_rank"))
        low = F.min("own_raw").over(all_.orderBy("own_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing))
        out = t.withColumn("adjusted", F.least(F.lit(1.0), low)).drop("own_rank", "own_n", "own_raw")
    return out.withColumn("significant", F.col("adjusted") < alpha)
