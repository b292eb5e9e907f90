"""Searches by fold statistics against one fit per point and fold."""

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from vectorloom.operators import assembly, classify, fold_search

SCHEMA = "id long, features array<double>, label int, fold int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    labels = rng.choice(4, 900, p=[0.6, 0.2, 0.15, 0.05])
    points = np.abs(rng.normal(size=(900, 5)) + labels[:, None] * 0.6)
    points[:, 4] = 100 + 0.01 * points[:, 4]  # a large mean with a small spread
    data = [(i, p.tolist(), int(y), int(rng.integers(0, 4))) for i, (p, y) in enumerate(zip(points, labels))]
    data += [(1000, [1.0, 2.0, 3.0, 4.0, 100.0], 9, 2)]  # a class that only one fold has
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


def fitted(rows, estimator):
    accuracies = []
    frame = assembly.training_frame(rows, "features", "label", ["fold"])
    for one in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        model = estimator.fit(frame.where(F.col("fold") != one))
        held = model.transform(frame.where(F.col("fold") == one))
        accuracies.append(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(held))
    return np.mean(accuracies), np.std(accuracies)


def test_multinomial_equals_one_fit_a_fold(rows):
    seen = rows.where("label < 9")  # Spark's fit takes a class that it never saw for an index gap
    points = [0.01, 1.0, 50.0]
    report = {r["point"]: r for r in fold_search.multinomial_search(seen, "features", "label", "fold", points).collect()}
    for k, smoothing in enumerate(points):
        mean, deviation = fitted(seen, classify.multinomial_naive_bayes().setSmoothing(smoothing))
        assert report[k]["fold_mean"] == pytest.approx(mean) and report[k]["fold_std"] == pytest.approx(deviation)
    best = max(points, key=lambda p: report[points.index(p)]["fold_mean"])
    assert report[points.index(best)]["rank"] == 1


def test_gaussian_equals_one_fit_a_fold(rows):
    seen = rows.where("label < 9")
    report = fold_search.gaussian_search(seen, "features", "label", "fold", [1e-9]).first()
    mean, deviation = fitted(seen, classify.gaussian_naive_bayes())
    assert report["fold_mean"] == pytest.approx(mean) and report["fold_std"] == pytest.approx(deviation)


def test_statistics_do_not_depend_on_partitions(rows):
    one, many = (
        fold_search.FoldStatistics(fold_search.fold_statistics(rows.repartition(n), "features", "label", "fold").toArrow()) for n in (1, 13)
    )
    for fold in one.folds:
        a, b = one.rest(fold), many.rest(fold)
        assert sorted(a) == sorted(b) and (9 in a) == (fold != 2)
        left = rows.where(F.col("fold") != fold).collect()
        for label in a:
            x = np.array([r["features"] for r in left if r["label"] == label])
            for found in (a[label], b[label]):
                assert found[0] == len(x)
                assert found[1] == pytest.approx(x.mean(axis=0)) and found[2] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(axis=0), rel=1e-5, abs=1e-9)


def test_unseen_class_and_bad_rows(spark, rows):
    report = fold_search.gaussian_search(rows, "features", "label", "fold", [1e-3, 1.0]).collect()
    assert len(report) == 2 and {r["rank"] for r in report} == {1, 2}
    with pytest.raises(ValueError, match="no rows"):
        fold_search.gaussian_search(rows.where("id < 0"), "features", "label", "fold", [1.0])
    for bad in ([(1, [1.0], None, 0)], [(1, [1.0], 0, None)], [(1, [None], 0, 0)]):
        with pytest.raises(Exception, match="null"):
            fold_search.gaussian_search(spark.createDataFrame(bad, SCHEMA), "features", "label", "fold", [1.0])
    negative = spark.createDataFrame([(1, [-1.0], 0, 0), (2, [-2.0], 0, 1)], SCHEMA)
    with pytest.raises(Exception, match="non-negative"):
        fold_search.multinomial_search(negative, "features", "label", "fold", [1.0]).collect()
