import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vectorloom.operators import evaluate, folds


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    chances = rng.dirichlet(np.ones(3), 200)
    chances[0] = [1.0, 0.0, 0.0]
    labels = rng.integers(0, 3, 200)
    labels[0] = 2
    rows = [(i, "ab"[i % 2], c.tolist(), float(y), float(c.argmax())) for i, (c, y) in enumerate(zip(chances, labels))]
    return spark.createDataFrame(rows, "id long, part string, p array<double>, label double, prediction double").cache()


def test_scores_match_the_evaluator(scored):
    got = evaluate.loss_and_accuracy(scored, F.col("p")).first()
    ready = scored.withColumn("probability", array_to_vector("p"))
    for name, value in (("accuracy", got.accuracy), ("logLoss", got.log_loss)):
        assert MulticlassClassificationEvaluator(metricName=name).evaluate(ready) == pytest.approx(value, rel=1e-9)


def test_scores_by_group(scored):
    got = {r.part: r for r in evaluate.scores_by(scored, ["part"]).collect()}
    frame = scored.toPandas()
    for part, own in frame.groupby("part"):
        assert got[part].n == len(own)
        assert got[part].accuracy == pytest.approx((own.label == own.prediction).mean())
        assert got[part].majority_share == pytest.approx(own.label.value_counts().max() / len(own))


def test_confusion_counts_every_row(scored):
    assert evaluate.confusion(scored).agg(F.sum("n")).first()[0] == 200


def test_majority_takes_the_smaller_label_on_ties(spark):
    rows = spark.createDataFrame([(2,), (2,), (1,), (1,), (3,), (None,)], "y int")
    got = evaluate.majority_baseline(rows, "y").first()
    assert (got.n, got.majority_label, got.majority_share) == (5, 1, 0.4)


def test_fold_majority_with_a_label_missing_from_a_fold(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1), (0, 1), (1, 2), (1, 2), (1, 2), (1, 1)], "fold int, y int")
    got = {r.fold: (r.n, r.majority_label, r.accuracy) for r in evaluate.fold_majority(rows, "y", "fold").collect()}
    assert got == {0: (3, 2, 0.0), 1: (4, 1, 0.25)}


@pytest.mark.parametrize("n, k", [(10, 3), (2, 3), (9, 3), (301, 4)])
def test_stratified_folds_equal_ntile(spark, n, k):
    from pyspark.sql import Window

    rows = spark.range(n).select("id", (F.col("id") % 2).cast("int").alias("y"))
    wanted = rows.withColumn("fold", F.ntile(k).over(Window.partitionBy("y").orderBy("id")) - 1)
    got = folds.stratified_folds(rows, "id", "y", k)
    pair = lambda frame: sorted(map(tuple, frame.select("id", "y", "fold").collect()))
    assert pair(got) == pair(wanted)
    assert folds.with_folds(rows, got, "id").count() == n
