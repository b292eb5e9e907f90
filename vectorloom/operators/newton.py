"""Logistic regression by Newton's method (iteratively reweighted least squares) on blocks of rows.

An iteration is one scan. Every task adds up, over blocks of rows, the loss, the gradient `x' r` and the curvature `x' W x`; the sums
are cut into chunks that meet by number in a shuffle, so that no task holds more than its chunks and the driver gets
one sum, however many tasks report. The driver solves for the step. That takes memory with the square and time
with the cube of the number of coefficients, which `MAX_COEFFICIENTS` bounds; wider models belong to the gradient
methods of `classify.py`.

Two classes have one row of coefficients, more have one each, centred as Spark centres them. `penalty` weighs the squared coefficients
(not the intercepts) against the mean loss, as `regParam` does without standardisation. Coefficients that separate the classes
grow without end where there is no penalty; the fit then stops after `rounds`. Null or non-finite features, labels that are null or
not whole numbers from 0, and an empty table raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators import relu_perceptron as R

MAX_COEFFICIENTS = 4000
ROWS = 4096  # of a block
ROUNDS = 50


@dataclass
class Fit:
    weights: np.ndarray  # one row for two classes, else one per class; the last column is the intercept
    loss: float  # mean loss and penalty
    slope: np.ndarray  # of that, by weight
    rounds: int
    settled: bool

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights[:, :-1]

    @property
    def intercepts(self) -> np.ndarray:
        return self.weights[:, -1]


def chances(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each class that has a row of weights, and the scores."""
    scores = x @ weights.T
    if len(weights) == 1:
        return R.outputs_of(scores, "sigmoid"), scores
    return R.outputs_of(scores, "softmax"), scores


def block_sums(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, curved: bool = True) -> np.ndarray:
    """Rows, loss, slope and curvature of a block, as one vector."""
    p, scores = chances(x, weights)
    if len(weights) == 1:
        losses = np.logaddexp(0, scores[:, 0]) - labels * scores[:, 0]
        miss = p - labels[:, None]
    else:
        losses = R.losses_of(scores, labels, "softmax")
        miss = p - np.eye(len(weights))[labels]
    parts = [[len(x), losses.sum()], (miss.T @ x).ravel()]
    if curved:
        rows, width = weights.shape
        curvature = np.zeros((rows, width, rows, width))
        for a in range(rows):
            for b in range(a, rows):
                weight = p[:, a] * ((a == b) - p[:, b])
                curvature[a, :, b] = curvature[b, :, a] = (x * weight[:, None]).T @ x
        parts.append(curvature.ravel())
    return np.concatenate(parts)


def _task(shared, width: int, classes: int, intercept: bool, curved: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = shared.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            if batch.column(0).null_count or labels.min() < 0 or labels.max() >= classes:
                raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
            rows = R.dense_rows(batch.column(1), width).astype(np.float64, copy=False)
            for at in range(0, len(rows), ROWS):
                x = rows[at : at + ROWS]
                x = np.hstack([x, np.full((len(x), 1), float(intercept))])
                sums = block_sums(x, labels[at : at + ROWS].astype(np.int64), weights, curved)
                total = sums if total is None else total + sums
        if total is not None:
            pieces = [total[low : low + R.CHUNK] for low in range(0, len(total), R.CHUNK)]
            yield R._parts_batch([0] * len(pieces), list(range(len(pieces))), pieces)

    return run


def sums_at(rows: DataFrame, weights: np.ndarray, classes: int, intercept: bool = True, curved: bool = True) -> np.ndarray:
    """`block_sums` over all of `rows` (label, features)."""
    width = weights.shape[1]
    size = 2 + weights.size + (weights.size**2 if curved else 0)
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    columns = "net int, chunk int, part binary"
    try:
        parts = rows.mapInArrow(_task(shared, width - 1, classes, intercept, curved), columns)
        table = parts.repartition("chunk").mapInArrow(R._adding_task("float64"), columns).toArrow()
    finally:
        shared.destroy()
    total = np.zeros(size)
    for chunk, part in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist()):
        total[chunk * R.CHUNK : chunk * R.CHUNK + R.CHUNK] = np.frombuffer(part, np.float64)
    if not total[0]:
        raise ValueError("there are no rows to fit on")
    return total


def labelled(rows: DataFrame, features: str, label: str) -> DataFrame:
    kind = rows.schema[features].dataType
    values = vector_to_array(features) if isinstance(kind, VectorUDT) else F.col(features).cast("array<double>")
    return rows.select(R.whole_label(F.col(label)).alias("label"), values.alias("features"))


def fit(
    rows: DataFrame,
    features: str,
    label: str,
    width: int,
    classes: int = 2,
    penalty: float = 0.0,
    intercept: bool = True,
    rounds: int = ROUNDS,
    tolerance: float = 1e-10,
) -> Fit:
    """Newton's method with halved steps where the loss would rise, until no slope exceeds `tolerance`."""
    lines = 1 if classes == 2 else classes
    if lines * (width + 1) > MAX_COEFFICIENTS:
        raise ValueError(f"{lines * (width + 1)} coefficients exceed the limit of {MAX_COEFFICIENTS}")
    shaped = labelled(rows, features, label)
    pull = np.full((lines, width + 1), float(penalty))
    pull[:, -1] = 0.0
    weights, last, step = np.zeros((lines, width + 1)), None, None
    for number in range(1, rounds + 1):
        total = sums_at(shaped, weights, classes, intercept)
        n = total[0]
        loss = total[1] / n + 0.5 * (pull * weights**2).sum()
        slope = total[2 : 2 + weights.size].reshape(weights.shape) / n + pull * weights
        curvature = total[2 + weights.size :].reshape(weights.size, weights.size) / n + np.diag(pull.ravel())
        now = Fit(weights, float(loss), slope, number, bool(np.abs(slope).max() <= tolerance))
        if now.settled:
            return now
        if last is not None and loss > last.loss + 1e-12 * abs(last.loss):
            if np.abs(step).max() <= 1e-12:
                return last
            step = step / 2
            weights = last.weights + step
            continue
        # The least step that solves: it keeps centred coefficients centred.
        step = -np.linalg.lstsq(curvature, slope.ravel(), rcond=1e-12)[0].reshape(weights.shape)
        if np.abs(step).max() <= 1e-13 * max(1.0, np.abs(weights).max()):
            return Fit(weights, now.loss, slope, number, True)
        last, weights = now, weights + step
    return now


def predict(rows: DataFrame, features: str, model: Fit) -> DataFrame:
    """`rows` with `probability` (one number per class) and `prediction`."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)
    width = model.weights.shape[1] - 1

    @F.arrow_udf("array<double>")
    def probability(values: pa.Array) -> pa.Array:
        x = R.dense_rows(values, width).astype(np.float64)
        p, _ = chances(np.hstack([x, np.ones((len(x), 1))]), shared.value)
        p = np.hstack([1 - p, p]) if p.shape[1] == 1 else p
        offsets = np.arange(len(x) + 1, dtype=np.int32) * p.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel()))

    scored = rows.withColumn("probability", probability(F.col(features).cast("array<double>")))
    return scored.withColumn("prediction", R.arg_max(F.col("probability")).cast("int"))
