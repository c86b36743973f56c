"""The recogniser's worked example and its errors."""

import pytest
from pyspark.sql import functions as F

from lexarium.functions import features as X
from lexarium.operators import recognize as R


def test_worked_example(spark):
    priors, cond = R.sample_tables(spark)
    scores = {r["feature"]: r for r in R.feature_scores(priors, cond).collect()}
    assert scores["f1"]["error"] == pytest.approx(0.49) and scores["f2"]["error"] == pytest.approx(0.50)
    assert scores["f1"]["informativeness"] == pytest.approx(0.049849, abs=1e-6) and scores["f2"]["informativeness"] == pytest.approx(0.030503, abs=1e-6)
    assert R.pair_scores(priors, cond).first()["error"] == pytest.approx(0.472)
    assert R.run(priors, cond).first()["min_error"] == pytest.approx(0.472)


def test_noise_is_reproducible(spark):
    priors, cond = R.sample_tables(spark)
    key = ["feature", "class", "value"]
    once, again = (R.add_noise(cond, 0.05, 123).orderBy(*key).collect() for _ in range(2))
    assert once == again
    sums = R.add_noise(cond, 0.05, 123).groupBy("feature", "class").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)


def test_segments(spark):
    df = spark.createDataFrame([(1, "a", "one two three"), (2, "a", "one two"), (3, "b", "much longer words everywhere!"), (4, "b", "extraordinary vocabulary!")], "doc_id bigint, label string, text string")
    summary, predicted = R.train_and_predict(df, "baseline")
    assert {r["predicted"] for r in predicted.collect()} <= {"a", "b"} and summary.count() == 1
    with pytest.raises(ValueError):
        R.train(R.discretise(df.withColumn("label", F.lit(None).cast("string")), X.profile("baseline")))
    with pytest.raises(ValueError):
        X.profile("none")
