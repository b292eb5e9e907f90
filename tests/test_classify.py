import numpy as np
import pytest
from blobs import blob_arrays
from pyspark.sql import functions as F

from vectorloom.operators import assembly, classify, tune


@pytest.fixture(scope="module")
def ready(blobs):
    return assembly.training_frame(blobs, "features", "label", ["id"]).cache()


def accuracy(model, rows):
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize(
    "estimator",
    [
        lambda: classify.logistic_regression(),
        lambda: classify.penalised_logistic_regression(200),
        lambda: classify.gaussian_naive_bayes(),
        lambda: classify.sigmoid_perceptron([4, 5, 2], max_iter=60, solver="l-bfgs"),
    ],
    ids=["lr", "lr-l2", "gnb", "mlp"],
)
def test_beats_the_majority(ready, estimator):
    assert accuracy(estimator().fit(ready), ready) > 0.9


def test_penalised_fit_is_stationary(ready):
    """The gradient of sum(log loss) + |w|^2 / 2 vanishes at the fit."""
    model = classify.penalised_logistic_regression(200, tol=1e-10).fit(ready)
    points, labels = blob_arrays()
    weights = model.coefficients.toArray()
    chance = 1 / (1 + np.exp(-(points @ weights + model.intercept)))
    np.testing.assert_allclose(points.T @ (chance - labels) + weights, 0, atol=1e-3)
    assert (chance - labels).sum() == pytest.approx(0, abs=1e-3)


def test_multinomial_refuses_negative_features(ready):
    with pytest.raises(Exception, match="(?i)negative"):
        classify.multinomial_naive_bayes().fit(ready)


def test_one_class_only(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 0), ([1.0, 2.0], 0)], "f array<double>, label int")
    ready = assembly.training_frame(rows, "f", "label")
    assert accuracy(classify.gaussian_naive_bayes().fit(ready), ready) == 1.0


def test_grid_order_and_fixed_settings(spark):
    estimator = classify.sigmoid_perceptron([4, 5, 2])
    layers = tune.perceptron_layers(4, [[5], [3, 2]], 2)
    grid = tune.grid_of(estimator, {"layers": layers, "stepSize": [0.1, 0.2]}, {"maxIter": 3})
    named = [{p.name: v for p, v in point.items()} for point in grid]
    assert [(n["layers"], n["stepSize"]) for n in named] == [
        ([4, 5, 2], 0.1), ([4, 5, 2], 0.2), ([4, 3, 2, 2], 0.1), ([4, 3, 2, 2], 0.2)]
    assert all(n["maxIter"] == 3 for n in named)


def test_search_reports_every_point(spark, ready, tmp_path):
    rows = ready.withColumn("fold", (F.col("id") % 3).cast("int"))
    estimator = classify.logistic_regression()
    grid = tune.grid_of(estimator, {"regParam": [5.0, 0.0, 0.0]})
    model = tune.cross_validate(rows, estimator, grid, fold_column="fold")
    report = tune.grid_report(spark, model)
    got = {r.point: r for r in report.collect()}
    assert [got[i].fold_mean for i in range(3)] == pytest.approx(list(model.avgMetrics))
    assert got[1].rank == 1 and got[2].rank == 2 and got[0].rank == 3
    assert tune.best_point(report).first().params == '{"regParam": 0.0}'
    tune.write_report(report, str(tmp_path / "grid"))
    assert spark.read.json(str(tmp_path / "grid")).count() == 3
