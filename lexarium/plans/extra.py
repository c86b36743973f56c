"""Queries for chart data, vectors, splits and the classifiers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from lexarium.operators import attribution, chart_data, classify, entropy

from .base import HOW, corpus, query, r, read, rounded
from .corpus_metrics import _HS, _kept_entropies
from .text_metrics import _STATS


@query("viz01_cumulative_letters", f"{_STATS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, rank) AS ord FROM f WHERE count > 0) SELECT doc_id, letter, ord::INT AS \"order\", {r('sum(p) OVER (PARTITION BY doc_id ORDER BY ord)')} AS cumulative FROM o")
def _(spark, sf):
    s = entropy.letter_stats(entropy.letter_frame(corpus(spark, sf), HOW), HOW)
    return rounded(chart_data.cumulative_letters(s).select("doc_id", "letter", "order", "cumulative"))


@query("viz02_entropy_histogram", f"{_HS}, e AS (SELECT min(h) AS a, (max(h) - min(h)) / 20 AS w FROM hs) SELECT least(floor((h - a) / w), 19)::INT AS bin, count(*)::BIGINT AS n FROM hs, e GROUP BY 1")
def _(spark, sf):
    return chart_data.histogram(_kept_entropies(spark, sf), "h", 20).select("bin", "n")


@query("viz03_entropy_density")
def _(spark, sf):
    return rounded(chart_data.density(_kept_entropies(spark, sf), "h"))


@query("pip03_attribution_vector")
def _(spark, sf):
    return rounded(attribution.parts(corpus(spark, sf), HOW).select("doc_id", *[c.alias(k) for k, c in attribution.scaled().items()]))


@query("ml01_tfidf_svm")
def _(spark, sf):
    df = classify.split(corpus(spark, sf).select("doc_id", F.col("lang").alias("label"), "text"), "doc_id")
    return classify.tfidf_svm(df.where("is_train"), df.where(~F.col("is_train"))).select("doc_id", "label", "target", "prediction")


@query("ml02_metric_forest")
def _(spark, sf):
    frame = entropy.letter_frame(corpus(spark, sf), HOW, keep=("lang",))
    m = entropy.letter_metrics(HOW.size)
    names = ["entropy", "evenness", "simpson", "renyi_2", "mean_rank", "std_rank", "utilization", "redundancy"]
    df = classify.split(frame.select("doc_id", F.col("lang").alias("label"), *[m[k].alias(k) for k in names]), "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    return classify.metric_forest(names, trees=50).fit(df.where("is_train")).transform(df.where(~F.col("is_train"))).select("doc_id", "label", "target", "prediction")


@query("ml03_split_sizes")
def _(spark, sf):
    return classify.split(read(spark, sf, "documents"), "doc_id").groupBy("lang", "is_train").agg(F.count("*").alias("n"))
