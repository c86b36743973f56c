"""Supervised baselines with Spark ML: character n-grams with a linear classifier, metric vectors with trees, splits and scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexarium import runtime
from lexarium.functions import batch


def split(df: DataFrame, id_col: str, train_percent: int = 70, seed: int = 42) -> DataFrame:
    """``df`` with ``is_train``, by a hash of the id: stable for any partitioning and without a shuffle."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(100)) < train_percent)


def gram_vocabulary(docs: DataFrame, limit: int = 1000, text_col: str = "text") -> list[str]:
    """The most frequent n-grams of 1 to 3 characters of all lower-cased texts together, most frequent first (ties by n-gram)."""
    counts = runtime.map_texts(docs.select(F.lower(F.col(text_col)).alias("own_text")), "own_text", "gram string, n bigint", batch.gram_counts)
    top = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(limit)
    return [r["gram"] for r in top.collect()]


def gram_vectors(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` without the text and with ``tf``, the sparse vector of each lower-cased text's counts of the vocabulary."""
    source = docs.withColumn(text_col, F.lower(F.col(text_col)))
    return runtime.map_texts(source, text_col, StructType([StructField("tf", VectorUDT())]), lambda texts: batch.gram_vectors(texts, vocabulary))


def tfidf_svm(train: DataFrame, test: DataFrame, vocabulary: int = 1000, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """``test`` without its text and with ``target`` and ``prediction`` of linear classifiers, one for each label, over tf-idf weights; any number of labels.

    Grams are never rows: the vocabulary takes one pass over the training texts, and vectors are made from the texts where they are read.
    """
    index = StringIndexer(inputCol=label_col, outputCol="target", handleInvalid="keep").fit(train)
    grams = gram_vocabulary(train, vocabulary, text_col)
    vectors = lambda df: gram_vectors(index.transform(df), grams, text_col)
    stages = Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), OneVsRest(classifier=LinearSVC(maxIter=30), labelCol="target", featuresCol="features", parallelism=4)])
    return stages.fit(vectors(train)).transform(vectors(test))


def metric_forest(columns: list[str], trees: int = 100, scale: bool = True, boosted: bool = False, seed: int = 42) -> Pipeline:
    tree = GBTClassifier(labelCol="target", featuresCol="features", seed=seed) if boosted else RandomForestClassifier(labelCol="target", featuresCol="features", numTrees=trees, seed=seed)
    scaler = [StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)] if scale else []
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="target"), VectorAssembler(inputCols=columns, outputCol="raw" if scale else "features", handleInvalid="skip"), *scaler, tree])


def grid_search(columns: list[str], folds: int = 5, parallelism: int = 4, seed: int = 42) -> CrossValidator:
    pipeline = metric_forest(columns, seed=seed)
    forest = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.numTrees, [50, 100]).addGrid(forest.maxDepth, [5, 10]).build()
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="f1"), numFolds=folds, parallelism=parallelism, seed=seed)


def evaluate(predictions: DataFrame) -> dict[str, float]:
    names = ("accuracy", "weightedPrecision", "weightedRecall", "f1")
    return {n: MulticlassClassificationEvaluator(labelCol="target", metricName=n).evaluate(predictions) for n in names}


def author_lexicons(counts: DataFrame, label_col: str = "label", most: int = 50, limit: int = 1000) -> DataFrame:
    """(label, item, score): per author one document; 1 + ln tf times a smoothed idf, length 1, above mean + half a deviation.

    ``counts`` is (label, item, n).  Items in more than 85 % of the authors' documents are left out.
    """
    from pyspark.sql import Window

    authors = counts.select(label_col).distinct().count()
    df = F.count("*").over(Window.partitionBy("item"))
    top = counts.groupBy("item").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "item").limit(limit).select("item")
    c = counts.withColumn("df", df).where(F.col("df") <= 0.85 * authors).join(F.broadcast(top), "item")
    w = Window.partitionBy(label_col)
    raw = (1 + F.log(F.col("n").cast("double"))) * (F.log((1.0 + authors) / (1 + F.col("df"))) + 1)
    c = c.withColumn("raw", raw).withColumn("score", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w)))
    cut = F.avg("score").over(w) + 0.5 * F.stddev_pop("score").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("score"), "item"))
    return c.withColumn("cut", cut).where("score > cut").withColumn("rank", rank).where(F.col("rank") <= most).select(label_col, "item", "score")
