"""Hyper-parameter grids with cross-validation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid_of(
    estimator: Estimator, values: Mapping[str, Sequence[Any]], fixed: Mapping[str, Any] | None = None
) -> list[dict]:
    """All combinations of `values`, the first name varying slowest, each with the `fixed` settings."""
    builder = ParamGridBuilder()
    for name, value in (fixed or {}).items():
        builder = builder.baseOn((estimator.getParam(name), value))
    for name, choices in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(choices))
    return builder.build()


def perceptron_layers(width: int, hidden: Sequence[Sequence[int]], classes: int) -> list[list[int]]:
    """Full layer lists from hidden layer sizes."""
    return [[width, *sizes, classes] for sizes in hidden]


def cross_validate(
    rows: DataFrame,
    estimator: Estimator,
    grid: list[dict],
    folds: int = 3,
    fold_column: str | None = None,
    parallelism: int = 2,
    evaluator: Evaluator | None = None,
    seed: int = 4321,
) -> CrossValidatorModel:
    """k-fold search. A fold column makes the folds reproducible; else Spark draws them."""
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator or MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    if fold_column:
        validator = validator.setFoldCol(fold_column)
    return validator.fit(rows)


def grid_report(spark: SparkSession, model: CrossValidatorModel) -> DataFrame:
    """One row per grid point: settings as JSON, mean and deviation over folds, rank.

    Ties go to the earlier point, as in the choice of the best model.
    """
    points = [
        (
            i,
            json.dumps({p.name: settings[p] for p in sorted(settings, key=lambda p: p.name)}),
            float(model.avgMetrics[i]),
            float(model.stdMetrics[i]) if model.stdMetrics else None,
        )
        for i, settings in enumerate(model.getEstimatorParamMaps())
    ]
    table = spark.createDataFrame(
        points, "point int, params string, fold_mean double, fold_std double"
    )
    better = F.desc if model.getEvaluator().isLargerBetter() else F.asc
    order = Window.orderBy(better("fold_mean"), F.asc("point"))
    return table.withColumn("rank", F.row_number().over(order))


def best_point(report: DataFrame) -> DataFrame:
    return report.where(F.col("rank") == 1)


def write_report(report: DataFrame, path: str) -> None:
    """Keep a grid report as JSON lines."""
    report.coalesce(1).write.mode("errorifexists").json(path)
