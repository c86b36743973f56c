"""A discrete probabilistic recogniser: tables, error and informativeness of features and pairs, predictions.

Tables are long: priors (class, prior) and cond (feature, idx, class, value, p).  They are as small as the number of classes and bins.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.functions import features as X
from lexarium.functions import text as T

EPS = 1e-12


def discretise(segments: DataFrame, names: list[str], id_col: str = "doc_id", label_col: str = "label", text_col: str = "text", lexicons: dict[str, list[str]] | None = None, own: dict[str, Column] | None = None) -> DataFrame:
    """(id, label, feature, idx, value): the bins of every text, one row per feature.  ``own`` adds features as columns over the text."""
    base = segments.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    base = X.measured(base, names, keep_text=bool(lexicons or own))
    if lexicons:
        base = base.withColumn("own_words", T.any_words(F.col("text")))
    made = X.labels(names) | {f"lexicon_{k}": X.lexicon_density(v) for k, v in (lexicons or {}).items()} | (own or {})
    wide = base.select("id", "label", *[c.alias(k) for k, c in made.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(i).alias("idx"), F.col(f"`{k}`").alias("value")) for i, k in enumerate(made)])
    return wide.select("id", "label", F.explode(rows).alias("x")).select("id", "label", "x.*")


def kept(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def train(values: DataFrame, smoothing: float = 1.0, balance: bool = True) -> tuple[DataFrame, DataFrame]:
    """Priors and smoothed conditional tables over the values that occur; unlabelled rows are left out.  Fewer than two classes are an error.

    ``values`` are read several times.
    """
    known = values.where(F.col("label").isNotNull() & (F.col("label") != ""))
    per_class = known.groupBy(F.col("label").alias("class")).agg(F.count_distinct("id").alias("n"))
    classes = per_class.count()
    if classes < 2:
        raise ValueError("labelled segments of at least two classes are needed")
    priors = per_class.select("class", (F.lit(1.0 / classes) if balance else F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))
    counts = known.groupBy("feature", "idx", F.col("label").alias("class"), "value").agg(F.count("*").alias("n"))
    cells = counts.select("feature", "idx", "value").distinct().crossJoin(F.broadcast(per_class.select("class")))
    full = cells.join(counts, ["feature", "idx", "class", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + smoothing)
    w = Window.partitionBy("feature", "class")
    size = F.sum("n").over(w)
    return priors, full.select("feature", "idx", "class", "value", F.when(size > 0, F.col("n") / size).otherwise(1.0 / F.count("*").over(w)).alias("p"))


def feature_scores(priors: DataFrame, cond: DataFrame) -> DataFrame:
    """(feature, idx, error, informativeness): the error of the best guess from the feature's value, and what the value tells of the class in bits."""
    j = cond.join(F.broadcast(priors), "class").withColumn("joint", F.col("p") * F.col("prior"))
    px = F.sum("joint").over(Window.partitionBy("feature", "value"))
    post = F.col("joint") / F.col("px")
    v = j.withColumn("px", px).groupBy("feature", "idx", "value").agg(F.max("px").alias("px"), F.max("joint").alias("best"), F.sum(F.when(post > EPS, F.col("joint") * F.log2(post)).otherwise(0.0)).alias("info"))
    h = priors.agg((-F.sum(F.when(F.col("prior") > 0, F.col("prior") * F.log2("prior")).otherwise(0.0))).alias("h"))
    use = F.col("px") > EPS
    out = v.groupBy("feature", "idx").agg(F.sum(F.when(use, F.col("px") - F.col("best")).otherwise(0.0)).alias("error"), F.sum(F.when(use, F.col("info")).otherwise(0.0)).alias("info"))
    return out.crossJoin(F.broadcast(h)).select("feature", "idx", "error", (F.col("h") + F.col("info")).alias("informativeness"))


def pair_scores(priors: DataFrame, cond: DataFrame) -> DataFrame:
    """(first, second, i, j, error) for all pairs of features, taken as independent within a class."""
    a = cond.select(F.col("feature").alias("first"), F.col("idx").alias("i"), "class", F.col("value").alias("x"), F.col("p").alias("pa"))
    b = cond.select(F.col("feature").alias("second"), F.col("idx").alias("j"), F.col("class").alias("class_b"), F.col("value").alias("y"), F.col("p").alias("pb"))
    both = a.join(b, (F.col("class") == F.col("class_b")) & (F.col("i") < F.col("j"))).join(F.broadcast(priors), "class").withColumn("joint", F.col("pa") * F.col("pb") * F.col("prior"))
    cells = both.groupBy("first", "second", "i", "j", "x", "y").agg(F.sum("joint").alias("pxy"), F.max("joint").alias("best"))
    return cells.groupBy("first", "second", "i", "j").agg(F.sum(F.when(F.col("pxy") > EPS, F.col("pxy") - F.col("best")).otherwise(0.0)).alias("error"))


def run(priors: DataFrame, cond: DataFrame, noise: float = 0.0, seed: int = 123) -> DataFrame:
    """One row per run (clean, and noisy if asked): best feature, best pair, the smaller error, and the noisy run's change."""
    def one(c: DataFrame, name: str) -> DataFrame:
        f = feature_scores(priors, c).orderBy("error", F.desc("informativeness"), "idx").limit(1).select(F.col("feature").alias("best_feature"), F.col("error").alias("feature_error"))
        p = pair_scores(priors, c).orderBy("error", "i", "j").limit(1).select(F.concat_ws("+", "first", "second").alias("best_pair"), F.col("error").alias("pair_error"))
        return f.join(p, how="left").select(F.lit(name).alias("run"), "*", F.least("feature_error", "pair_error").alias("min_error"))

    clean = one(cond, "clean")
    if not noise:
        return clean
    noisy = one(add_noise(cond, noise, seed), "noisy")
    base = clean.select(F.col("min_error").alias("clean_error"))
    delta = F.col("min_error") - F.col("clean_error")
    return clean.withColumns({"delta": F.lit(0.0), "relative": F.lit(0.0)}).unionByName(noisy.crossJoin(base).withColumns({"delta": delta, "relative": F.when(F.col("min_error") > EPS, delta / F.col("min_error")).otherwise(0.0)}).drop("clean_error"))


def add_noise(cond: DataFrame, factor: float, seed: int = 123) -> DataFrame:
    """Uniform noise on the (small) conditional tables, rows normalised again; a seed gives the same tables each time."""
    if factor < 0:
        raise ValueError("the noise factor must not be negative")
    spark = cond.sparkSession
    t = cond.toPandas().sort_values(["idx", "class", "value"], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng(seed)
    t["p"] = np.clip(t["p"] + rng.uniform(-factor, factor, len(t)), 0, None)
    size = t.groupby(["feature", "class"])["p"].transform("sum")
    kinds = t.groupby(["feature", "class"])["p"].transform("size")
    t["p"] = np.where(size > EPS, t["p"] / np.maximum(size, EPS), 1 / kinds)
    return spark.createDataFrame(t, cond.schema)


def predict(values: DataFrame, priors: DataFrame, cond: DataFrame) -> DataFrame:
    """(id, label, predicted, posterior): sums of logarithms, softmax, and the most likely class (ties: the first by name)."""
    classes = priors.count()
    cells = values.select("id", "label", "feature", "value").crossJoin(F.broadcast(priors))
    p = cells.join(F.broadcast(cond.select("feature", "class", "value", "p")), ["feature", "class", "value"], "left")
    log_p = F.log(F.greatest(F.coalesce("p", F.lit(1.0 / classes)), F.lit(EPS)))
    s = p.groupBy("id", "label", "class").agg((F.sum(log_p) + F.log(F.greatest(F.max("prior"), F.lit(EPS)))).alias("s"))
    top = F.max("s").over(Window.partitionBy("id"))
    e = s.withColumn("e", F.exp(F.col("s") - top)).withColumn("posterior", F.col("e") / F.sum("e").over(Window.partitionBy("id")))
    best = e.groupBy("id", "label").agg(F.min(F.struct((-F.col("s")).alias("k"), "class", "posterior")).alias("b"))
    return best.select("id", "label", F.col("b.class").alias("predicted"), F.col("b.posterior").alias("posterior"))


def select_features(scores: DataFrame, top_k: int | None = None, least: float = 1e-6, fallback: int = 3) -> list[str]:
    """Informative features, best first; the best three if none is informative."""
    rows = scores.orderBy(F.desc("informativeness"), "idx").collect()
    good = [r["feature"] for r in rows if r["informativeness"] >= least]
    good = good or [r["feature"] for r in rows[:fallback]]
    return good[:top_k] if top_k else good


def train_and_predict(segments: DataFrame, profile: str = "baseline", smoothing: float = 1.0, top_k: int | None = None, **names: str) -> tuple[DataFrame, DataFrame]:
    """The run summary and the predictions of all segments with the features of a profile.

    The bins are a few short strings a text and are read several times, so they are kept (in memory, else on the executors' disks); those of a lost executor
    are worked out again.
    """
    values = kept(discretise(segments, X.profile(profile), **names))
    priors, cond = (kept(t) for t in train(values, smoothing))
    chosen = select_features(feature_scores(priors, cond), top_k)
    cond = cond.where(F.col("feature").isin(chosen))
    return run(priors, cond), predict(values.where(F.col("feature").isin(chosen)), priors, cond)


def sample_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The worked example: three classes, a feature of two values and one of three."""
    priors = spark.createDataFrame([("A1", 0.3), ("A2", 0.5), ("A3", 0.2)], "class string, prior double")
    tables = {"f1": [[0.7, 0.3], [0.4, 0.6], [0.5, 0.5]], "f2": [[0.2, 0.5, 0.3], [0.3, 0.4, 0.3], [0.1, 0.6, 0.3]]}
    rows = [(f, i, f"A{k + 1}", str(v), p) for i, (f, t) in enumerate(tables.items()) for k, line in enumerate(t) for v, p in enumerate(line)]
    return priors, spark.createDataFrame(rows, "feature string, idx int, class string, value string, p double")


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("label").isNotNull()).groupBy("label", "predicted").agg(F.count("*").alias("n"), F.avg("posterior").alias("confidence"))
