"""The data behind charts: histograms, densities, cumulative shares, rank curves and radar axes.  Drawing is left to others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions import numeric as N


def cumulative_letters(stats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Letters of each id by frequency, with the running share."""
    w = Window.partitionBy(id_col).orderBy(F.desc("count"), "rank")
    return stats.where("count > 0").withColumn("order", F.row_number().over(w)).withColumn("cumulative", F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def histogram(df: DataFrame, v: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) over equal widths from the least to the largest value; the largest belongs to the last bin."""
    edge = df.agg(F.min(v).alias("low_v"), F.max(v).alias("high_v"))
    width = (F.col("high_v") - F.col("low_v")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(v) - F.col("low_v")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    rows = df.where(F.col(v).isNotNull()).crossJoin(F.broadcast(edge)).select(at.cast("int").alias("bin"), "low_v", width.alias("width"))
    return rows.groupBy("bin").agg((F.max("low_v") + F.col("bin") * F.max("width")).alias("low"), (F.max("low_v") + (F.col("bin") + 1) * F.max("width")).alias("high"), F.count("*").alias("n"))


def density(df: DataFrame, v: str, points: int = 100, bins: int = 2048) -> DataFrame:
    """(x, density) of a Gaussian kernel over a grid; values are first counted in ``bins`` narrow bins, so the driver gets a bounded table.  Empty for 5 values or fewer."""
    rows = histogram(df, v, bins).collect()
    n = sum(r["n"] for r in rows)
    spark = df.sparkSession
    if n <= 5:
        return spark.createDataFrame([], "x double, density double")
    x, counts = np.array([(r["low"] + r["high"]) / 2 for r in rows]), np.array([r["n"] for r in rows])
    grid = np.linspace(x.min(), x.max(), points)
    d = N.gaussian_kde(x, grid, counts) if x.std() > 0 else np.zeros(points)
    return spark.createDataFrame(list(zip(grid.tolist(), d.tolist(), strict=True)), "x double, density double")


def rank_curve(counts: DataFrame, fit: DataFrame, id_col: str = "doc_id", top: int = 200) -> DataFrame:
    """(id, rank, n, expected): counts by rank and the fitted law c / rank^alpha through the largest count."""
    w = Window.partitionBy(id_col)
    r = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "item"))).withColumn("top", F.max("n").over(w)).where(F.col("rank") <= top)
    return r.join(fit, id_col).select(id_col, "rank", "n", (F.col("top") / F.pow(F.col("rank").cast("double"), F.col("zipf_alpha"))).alias("expected"))


def rolling_band(rolled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mean, deviation (population) and extremes of each id's rolling entropies; the band is mean plus and minus the deviation."""
    return rolled.groupBy(id_col).agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("std"), F.min("entropy").alias("min"), F.max("entropy").alias("max"), F.count("*").alias("windows"))


def radar(metrics: DataFrame, alphabet_size: int, id_col: str = "doc_id") -> DataFrame:
    return metrics.select(id_col, "entropy_normalized", "gini_simpson", F.least(F.col("zipf_alpha") / 2, F.lit(1.0)).alias("zipf"), (F.col("n_kinds") / alphabet_size).alias("letters"))
