"""Newton's method against Spark's own fits and by hand."""

import numpy as np
import pytest
from blobs import blob_arrays
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from vectorloom.operators import assembly, newton


def frame_of(spark, points, labels):
    rows = [(i, p.tolist(), int(y)) for i, (p, y) in enumerate(zip(points, labels))]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def clouds(spark):
    points, labels = blob_arrays(gap=0.8)
    return frame_of(spark, points, labels)


@pytest.mark.parametrize("penalty", [0.0, 0.03])
@pytest.mark.parametrize("classes", [2, 3])
def test_coefficients_equal_sparks(spark, clouds, classes, penalty):
    rows = clouds if classes == 2 else clouds.withColumn("label", F.when(F.col("id") % 7 == 3, 2).otherwise(F.col("label")))
    found = newton.fit(rows, "features", "label", 4, classes, penalty)
    shaped = assembly.training_frame(rows, "features", "label", ["id"])
    spark_fit = LogisticRegression(regParam=penalty, standardization=False, tol=1e-14, maxIter=500).fit(shaped)
    assert found.settled and found.rounds < 12
    assert found.coefficients == pytest.approx(spark_fit.coefficientMatrix.toArray(), abs=1e-6)
    assert found.intercepts == pytest.approx(spark_fit.interceptVector.toArray(), abs=1e-6)
    ours = [r["prediction"] for r in newton.predict(rows, "features", found).orderBy("id").collect()]
    theirs = [int(r["prediction"]) for r in spark_fit.transform(shaped).orderBy("id").collect()]
    assert ours == theirs


@pytest.mark.parametrize("classes", [2, 4])
def test_slope_and_curvature_by_differences(classes):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 3)), rng.integers(0, classes, 30)
    weights = rng.normal(size=(1 if classes == 2 else classes, 3))
    size = weights.size
    total = newton.block_sums(x, y, weights)
    for k in range(size):
        step = np.zeros(size)
        step[k] = 1e-6
        up, down = (newton.block_sums(x, y, weights + s * step.reshape(weights.shape)) for s in (1, -1))
        assert (up[1] - down[1]) / 2e-6 == pytest.approx(total[2 + k], abs=1e-5)
        slopes = (up[2 : 2 + size] - down[2 : 2 + size]) / 2e-6
        assert slopes == pytest.approx(total[2 + size :].reshape(size, size)[k], abs=1e-5)


def test_many_chunks_and_partitions_give_the_same(clouds, monkeypatch):
    plain = newton.fit(clouds, "features", "label", 4)
    monkeypatch.setattr(newton.R, "CHUNK", 5)
    monkeypatch.setattr(newton, "ROWS", 7)
    cut = newton.fit(clouds.repartition(9), "features", "label", 4)
    assert cut.weights == pytest.approx(plain.weights, abs=1e-9)


def test_separated_classes_and_bad_rows(spark):
    apart = frame_of(spark, np.array([[-1.0], [-2.0], [1.0], [2.0]]), [0, 0, 1, 1])
    found = newton.fit(apart, "features", "label", 1, rounds=8)
    assert np.isfinite(found.weights).all() and found.coefficients[0, 0] > 3
    with pytest.raises(ValueError, match="no rows"):
        newton.fit(apart.where("id < 0"), "features", "label", 1)
    with pytest.raises(ValueError, match="limit"):
        newton.fit(apart, "features", "label", 5000)
    for bad in ([(1, [None], 1)], [(1, [1.0], None)], [(1, [1.0], 3)], [(1, [float("nan")], 1)]):
        with pytest.raises(Exception, match="whole numbers|non-null|finite"):
            newton.fit(spark.createDataFrame(bad, "id long, features array<double>, label int"), "features", "label", 1)
