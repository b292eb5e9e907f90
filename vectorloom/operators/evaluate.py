"""Scores of predictions. Everything is one aggregation to a few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-15


def scores_by(
    predictions: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows, accuracy and share of the most frequent label, per group.

    Accuracy alone hides a model that always answers with the majority class, hence both.
    """
    right = (F.col(prediction) == F.col(label)).cast("bigint")
    per_label = predictions.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(right).alias("_right")
    )
    return per_label.groupBy(*by).agg(
        F.sum("_rows").alias("n"),
        (F.sum("_right") / F.sum("_rows")).alias("accuracy"),
        (F.max("_rows") / F.sum("_rows")).alias("majority_share"),
    )


def confusion(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Number of rows per label and prediction."""
    return predictions.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def majority_baseline(rows: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent label, the smallest on ties, and its share, per group."""
    per_label = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    first = F.min_by(label, F.struct(-F.col("_rows"), F.col(label)))
    return per_label.groupBy(*by).agg(
        F.sum("_rows").alias("n"),
        first.alias("majority_label"),
        (F.max("_rows") / F.sum("_rows")).alias("majority_share"),
    )


def fold_majority(rows: DataFrame, label: str, fold: str) -> DataFrame:
    """Per fold, the accuracy of the majority label of the other folds.

    Works on counts per fold and label, so the all-but-one sums need no second look at the rows.
    """
    cells = rows.groupBy(fold, label).agg(F.count(F.lit(1)).alias("_rows"))
    totals = cells.groupBy(label).agg(F.sum("_rows").alias("_all"))
    folds = cells.groupBy(fold).agg(F.sum("_rows").alias("_held"))
    # Labels that do not occur in a fold still compete for being its majority: pair each fold with
    # all labels, which are a handful of counts by now.
    every = totals.agg(F.collect_list(F.struct(F.col(label).alias("label"), "_all"))).scalar()
    pairs = folds.select(fold, "_held", F.inline(every)).withColumnRenamed("label", label)
    hits = F.coalesce(F.col("_rows"), F.lit(0))
    ranked = F.struct((hits - F.col("_all")).alias("order"), F.col(label).alias("label"), hits.alias("hits"))
    return (
        pairs.join(cells, [fold, label], "left")
        .groupBy(fold)
        .agg(F.max("_held").alias("n"), F.min(ranked).alias("_best"))
        .select(
            fold,
            "n",
            F.col("_best.label").alias("majority_label"),
            (F.col("_best.hits") / F.col("n")).alias("accuracy"),
        )
    )


def probability_of_label(probability: Column, label: Column) -> Column:
    """The entry of a probability array at the label."""
    return F.element_at(probability, label.cast("int") + 1)


def loss_and_accuracy(
    predictions: DataFrame,
    probability: Column,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Cross-entropy and accuracy in one pass. `probability` is an array column."""
    chance = F.greatest(probability_of_label(probability, F.col(label)), F.lit(TINY))
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.log(chance)).alias("log_loss"),
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"),
    )
