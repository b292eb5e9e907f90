"""The classifiers of `pyspark.ml`, set up the way the comparisons use them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    NaiveBayesModel,
)
from pyspark.sql import DataFrame, SparkSession

COLUMNS = {"featuresCol": "features", "labelCol": "label"}


def logistic_regression(**params) -> LogisticRegression:
    """Unpenalised logistic regression, 100 iterations unless said otherwise."""
    return LogisticRegression(**(COLUMNS | params))


def penalised_logistic_regression(
    rows: int, strength: float = 1.0, max_iter: int = 1000, **params
) -> LogisticRegression:
    """L2 penalty stated per sum of losses (`1 / strength`) rather than per mean.

    Spark averages the loss, so the same optimum needs the penalty divided by the row count.
    """
    settings = {
        "regParam": 1.0 / (strength * rows),
        "elasticNetParam": 0.0,
        "standardization": False,
        "maxIter": max_iter,
    }
    return LogisticRegression(**(COLUMNS | settings | params))


def multinomial_naive_bayes(**params) -> NaiveBayes:
    """For non-negative features such as counts or probabilities."""
    return NaiveBayes(**(COLUMNS | {"modelType": "multinomial"} | params))


def gaussian_naive_bayes(**params) -> NaiveBayes:
    return NaiveBayes(**(COLUMNS | {"modelType": "gaussian"} | params))


def sigmoid_perceptron(
    layers: Sequence[int],
    max_iter: int = 20,
    block_size: int = 7597,
    seed: int = 4321,
    solver: str = "gd",
    **params,
) -> MultilayerPerceptronClassifier:
    """Perceptron with sigmoid hidden layers, trained by gradient descent over row blocks."""
    settings = {
        "layers": list(layers),
        "maxIter": max_iter,
        "blockSize": block_size,
        "seed": seed,
        "solver": solver,
    }
    return MultilayerPerceptronClassifier(**(COLUMNS | settings | params))


def naive_bayes_parameters(spark: SparkSession, model: NaiveBayesModel) -> DataFrame:
    """The fitted parameters as a table: label, position, prior, mean or log rate, variance."""
    pi, theta = model.pi.toArray(), model.theta.toArray()
    classes, width = theta.shape
    gaussian = model.getModelType() == "gaussian"
    sigma = model.sigma.toArray().ravel() if gaussian else None
    table = pa.table(
        {
            "label": pa.array(np.repeat(np.arange(classes, dtype=np.int32), width)),
            "pos": pa.array(np.tile(np.arange(width, dtype=np.int32), classes)),
            "pi": pa.array(np.repeat(pi, width)),
            "theta": pa.array(theta.ravel()),
            "sigma": pa.array(sigma) if gaussian else pa.nulls(classes * width, pa.float64()),
        }
    )
    return spark.createDataFrame(table)
