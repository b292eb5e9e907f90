"""Putting features and labels together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V

MAX_CLASSES = 10_000


def join_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features with their labels, matched by key.

    A plain equi-join: Spark broadcasts the label table while its size allows it, and otherwise
    shuffles both sides, where AQE splits the partitions of a hot key.
    """
    return features.join(labels, key, "inner")


def unmatched(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Feature rows without a label. Only the key of the label table is read."""
    return features.join(labels.select(key), key, "left_anti")


def class_list(rows: DataFrame, name: str | Column, alias: str = "class_name") -> DataFrame:
    """The distinct class names in order."""
    column = F.col(name) if isinstance(name, str) else name
    return rows.select(column.alias(alias)).where(F.col(alias).isNotNull()).distinct().orderBy(alias)


def class_names(rows: DataFrame, name: str | Column, limit: int = MAX_CLASSES) -> list[str]:
    """The class list as a Python list, for use as the constant layout of a one-hot label.

    More than `limit` names means the column is no class column, and is an error.
    """
    names = [r[0] for r in class_list(rows, name).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} distinct class names")
    return names


def class_mask(rows: DataFrame, label: int, column: str = "label") -> DataFrame:
    """The rows of one class; the predicate reaches the scan."""
    return rows.where(F.col(column) == label)


def split_label(
    rows: DataFrame, matrix: str, classes: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Matrix rows `[features…, one-hot label]` as `features` and `label`, in one projection."""
    row = F.col(matrix)
    return rows.select(
        *keep,
        V.feature_slice(row, classes).alias("features"),
        V.arg_max(V.label_slice(row, classes)).alias("label"),
    )


def training_frame(
    rows: DataFrame, features: str, label: str | Column, keep: Sequence[str] = ()
) -> DataFrame:
    """What an estimator takes: a vector `features` and a numeric `label`, built in the executors."""
    target = F.col(label) if isinstance(label, str) else label
    return rows.select(
        *keep, V.features_of(F.col(features)).alias("features"), target.cast("double").alias("label")
    )
