"""Cross-validation of Naive Bayes by subtracting fold statistics.

A plain search fits every grid point on every choice of folds: points x folds passes over the data. Naive Bayes
needs only sums per class and column. One pass adds them up per fold; the model without a fold is the total
minus that fold's sums, for all grid points at once. A second pass scores every row under all points with the models
that have not seen its fold. Both passes add up in numpy within tasks; what is shuffled or reaches the driver is bounded
by folds x classes x columns, which is checked.

Rows with a null label, fold or feature raise. A class that a choice of folds never shows gets no prediction there. An
empty table raises.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.relu_perceptron import dense_rows, whole_label

MAX_CELLS = 20_000_000  # folds x classes x columns
MAX_GROUPS = 100_000  # folds x classes
SLICE = 1024  # rows scored at once


def _tidy(rows: DataFrame, features: str, label: str, fold: str) -> DataFrame:
    missing = F.raise_error(F.lit("label and fold must not be null")).cast("int")
    return rows.select(
        F.coalesce(F.col(fold).cast("int"), missing).alias("fold"),
        F.coalesce(whole_label(F.col(label)), missing).alias("label"),
        F.col(features).cast("array<double>").alias("features"),
    )


def fold_statistics(rows: DataFrame, features: str, label: str, fold: str) -> DataFrame:
    """(fold, label, n, mean, spread): rows, and per column their mean and sum of squared deviations.

    Tasks merge blocks by the rule for means and deviations, which keeps close values exact; then merged pairs meet in
    a shuffle by (fold, label), of which there are few rows per task.
    """
    tidy = _tidy(rows, features, label, fold)
    schema = "fold int, label int, n long, mean array<double>, spread array<double>"
    return tidy.mapInArrow(_summing, schema).repartition("fold", "label").mapInArrow(_merging, schema)


def _summed(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    return len(x), mean, ((x - mean) ** 2).sum(axis=0)


def merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap**2 * (a[0] * b[0] / n)


def without(total: tuple, part: tuple) -> tuple:
    """`merged`, undone: the statistics of the rest."""
    n = total[0] - part[0]
    mean = total[1] + (total[1] - part[1]) * (part[0] / n)
    return n, mean, np.maximum(total[2] - part[2] - (mean - part[1]) ** 2 * (n * part[0] / total[0]), 0.0)


def _batch(held: dict) -> pa.RecordBatch:
    keys = sorted(held)
    lists = [pa.array([held[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in (1, 2)]
    first = [pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*first, pa.array([held[k][0] for k in keys], pa.int64()), *lists], ["fold", "label", "n", "mean", "spread"])


def _summing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = dense_rows(batch.column(2), len(batch.column(2)[0]))
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        for key in np.unique(keys, axis=1).T:
            one = _summed(x[(keys == key[:, None]).all(axis=0)])
            key = tuple(key.tolist())
            held[key] = merged(held[key], one) if key in held else one
            if len(held) * x.shape[1] > MAX_CELLS:
                raise ValueError(f"folds x classes x columns exceed {MAX_CELLS}")
    if held:
        yield _batch(held)


def _merging(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        # In a fixed order, so that sums do not hang on which task was first.
        for row in sorted(batch.to_pylist(), key=lambda r: (r["fold"], r["label"], r["n"], r["mean"])):
            one = row["n"], np.array(row["mean"]), np.array(row["spread"])
            key = row["fold"], row["label"]
            held[key] = merged(held[key], one) if key in held else one
    if held:
        yield _batch(held)


class FoldStatistics:
    """Sums per fold and class on the driver, and what remains without a fold."""

    def __init__(self, table: pa.Table):
        parts = {(r["fold"], r["label"]): (r["n"], np.array(r["mean"]), np.array(r["spread"])) for r in table.to_pylist()}
        if not parts:
            raise ValueError("there are no rows to search on")
        self.parts = parts
        self.folds, self.labels = (sorted({k[i] for k in parts}) for i in (0, 1))
        self.width = len(next(iter(parts.values()))[1])
        self.totals = {label: self._sum([p for (_, own), p in sorted(parts.items()) if own == label]) for label in self.labels}

    @staticmethod
    def _sum(parts: list[tuple]) -> tuple:
        total = parts[0]
        for part in parts[1:]:
            total = merged(total, part)
        return total

    def rest(self, fold: int) -> dict[int, tuple]:
        """Per class the statistics of all rows outside a fold; classes with none are left out."""
        out = {}
        for label, total in self.totals.items():
            part = self.parts.get((fold, label))
            if part is None:
                out[label] = total
            elif part[0] < total[0]:
                out[label] = without(total, part)
        return out


# A model scores rows: y = x - center, then y @ weights + squares of y @ curves + offset.
Scorer = tuple[list[int], np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]


def multinomial_model(rest: dict[int, tuple], smoothing: float) -> Scorer:
    labels = sorted(rest)
    counts = np.array([rest[k][0] for k in labels], float)
    sums = np.array([rest[k][0] * rest[k][1] for k in labels])
    if (sums < 0).any():
        raise ValueError("multinomial Naive Bayes needs non-negative features")
    theta = np.log(sums + smoothing) - np.log(sums.sum(axis=1, keepdims=True) + smoothing * sums.shape[1])
    prior = np.log(counts + smoothing) - np.log(counts.sum() + smoothing * len(counts))
    return labels, np.zeros(sums.shape[1]), theta.T, None, prior


def gaussian_model(rest: dict[int, tuple], floor: float) -> Scorer:
    labels = sorted(rest)
    everything = FoldStatistics._sum([rest[k] for k in labels])
    least = floor * (everything[2] / max(everything[0] - 1, 1)).max()
    counts = np.array([rest[k][0] for k in labels], float)
    # About the common mean, so that squares of large values do not cancel.
    mean = np.array([rest[k][1] for k in labels]) - everything[1]
    spread = np.array([rest[k][2] / rest[k][0] for k in labels]) + least
    offset = np.log(counts / counts.sum()) - 0.5 * (np.log(2 * np.pi * spread) + mean**2 / spread).sum(axis=1)
    return labels, everything[1], (mean / spread).T, (-0.5 / spread).T, offset


def _search(
    rows: DataFrame, features: str, label: str, fold: str, points: Sequence[float], name: str, model: Callable[[dict, float], Scorer]
) -> DataFrame:
    spark = rows.sparkSession
    statistics = fold_statistics(rows, features, label, fold)
    held = FoldStatistics(statistics.limit(MAX_GROUPS + 1).toArrow())
    if len(held.parts) > MAX_GROUPS or len(held.parts) * held.width > MAX_CELLS:
        raise ValueError("too many folds, classes or columns for a search by statistics")
    shared = spark.sparkContext.broadcast(held)
    width = held.width

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, list[Scorer]] = {}
        hits: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense_rows(batch.column(2), width)
            folds, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for one in np.unique(folds).tolist():
                if one not in models:
                    rest = shared.value.rest(one)
                    models[one] = [model(rest, p) for p in points] if rest else []
                mine = np.flatnonzero(folds == one)
                for at in range(0, len(mine), SLICE):
                    part = mine[at : at + SLICE]
                    for k, (names, center, weights, curves, offset) in enumerate(models[one]):
                        y = x[part] - center
                        scores = y @ weights + offset
                        if curves is not None:
                            scores += y**2 @ curves
                        right = np.array(names)[scores.argmax(axis=1)] == labels[part]
                        hits[k, one] = hits.get((k, one), np.zeros(2, np.int64)) + [right.sum(), len(part)]
        keys = sorted(hits)
        columns = [pa.array([key[i] for key in keys], pa.int32()) for i in (0, 1)] + [pa.array([int(hits[key][i]) for key in keys], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["point", "fold", "hits", "n"])

    counts = _tidy(rows, features, label, fold).mapInArrow(scored, "point int, fold int, hits long, n long")
    folds = counts.groupBy("point", "fold").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))
    means = folds.groupBy("point").agg(F.avg("accuracy").alias("fold_mean"), F.stddev_pop("accuracy").alias("fold_std"))
    grid = spark.createDataFrame([(k, json.dumps({name: p})) for k, p in enumerate(points)], "point int, params string")
    # One row per point. Equal means may differ in their last bit by the order of folds; ties go to the earlier point.
    order = Window.orderBy(F.round("fold_mean", 12).desc(), F.asc("point"))
    report = grid.join(F.broadcast(means), "point").withColumn("rank", F.row_number().over(order))
    return report.select("point", "params", "fold_mean", "fold_std", "rank")


def multinomial_search(rows: DataFrame, features: str, label: str, fold: str, smoothing: Sequence[float]) -> DataFrame:
    """Report of multinomial Naive Bayes over smoothing values: mean and deviation of the fold accuracies, and rank."""
    return _search(rows, features, label, fold, smoothing, "smoothing", multinomial_model)


def gaussian_search(rows: DataFrame, features: str, label: str, fold: str, floors: Sequence[float]) -> DataFrame:
    """Report of Gaussian Naive Bayes over variance floors, as shares of the largest column variance."""
    return _search(rows, features, label, fold, floors, "varFloor", gaussian_model)
