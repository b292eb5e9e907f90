"""A perceptron with ReLU hidden layers, trained by synchronous data-parallel gradient steps.

Spark's own perceptron has neither ReLU, Adam, dropout nor validation, so this is an estimator of
its own. How a fit runs:

* The training rows are packed once, inside their partitions, into binary row blocks and cached.
* A step broadcasts the weights. Every partition sums the gradient over its blocks and cuts the sum
  into chunks; the chunks are shuffled by number and added up as they arrive. The reduction is
  thereby spread over many tasks, however large the network is and however many partitions report,
  and no task holds more than its chunks. Where all partial sums together are known to stay below
  `DIRECT_BYTES`, the driver adds them up itself.
* The driver receives one summed vector as long as the weights and applies the optimiser.

The weights are the only thing that is broadcast or brought to the driver. Their size follows from
`layers` and is checked against `MAX_WEIGHTS`.

Several settings of the same network can be trained in one pass over the data (`fitMultiple`), which
is what a grid search does: a step then costs one scan for the whole grid.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasRegParam,
    HasSeed,
    HasSolver,
    HasStepSize,
    HasValidationIndicatorCol,
)
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from vectorloom.functions.vectors import arg_max
from vectorloom.operators.training import Adam, BestWeights, EarlyStop, Plateau, Sgd

MAX_WEIGHTS = 100_000_000
CHUNK = 8192
BLOCK_BYTES = 4 * 1024 * 1024
BLOCK_ROWS = 8192
BUFFER_BYTES = 256 * 1024 * 1024
DIRECT_BYTES = 256 * 1024 * 1024
VALIDATION = -1
COUNTS = -1
HISTORY_SCHEMA = (
    "epoch int, steps int, rows bigint, learning_rate double, loss double, accuracy double, "
    "val_loss double, val_accuracy double"
)


# ---- the network on one block of rows ------------------------------------------------------------


def weight_count(layers: Sequence[int]) -> int:
    return sum((fan_in + 1) * fan_out for fan_in, fan_out in zip(layers, layers[1:]))


def layer_views(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight matrices and biases as views into the flat vector."""
    views, at = [], 0
    for fan_in, fan_out in zip(layers, layers[1:]):
        matrix = flat[at : at + fan_in * fan_out].reshape(fan_in, fan_out)
        at += fan_in * fan_out
        views.append((matrix, flat[at : at + fan_out]))
        at += fan_out
    return views


def glorot_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform initial weights scaled to the fan of each layer, zero biases."""
    rng, flat = np.random.default_rng(seed), np.zeros(weight_count(layers))
    for matrix, _ in layer_views(flat, layers):
        bound = np.sqrt(6.0 / sum(matrix.shape))
        matrix[:] = rng.uniform(-bound, bound, matrix.shape)
    return flat


def keep_mask(keys: np.ndarray, units: int, drop: float, salt: int) -> np.ndarray:
    """Inverted dropout mask from a hash of row key, unit and `salt`.

    It does not depend on where or in which order rows are processed, so a repeated task, or another
    number of partitions, draws the same mask.
    """
    with np.errstate(over="ignore"):
        state = keys.view(np.uint64)[:, None] + np.uint64(salt % 2**64)
        state = state * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, units + 1, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            state = (state ^ (state >> np.uint64(shift))) * np.uint64(factor)
        state ^= state >> np.uint64(31)
    draw = (state >> np.uint64(11)).astype(np.float64) / 2.0**53
    return (draw >= drop) / (1.0 - drop)


def outputs_of(scores: np.ndarray, loss: str) -> np.ndarray:
    if loss == "sigmoid":
        return 0.5 * (1.0 + np.tanh(0.5 * scores))
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def losses_of(scores: np.ndarray, labels: np.ndarray, loss: str) -> np.ndarray:
    """Cross-entropy per row, from scores, without overflow."""
    at_label = scores[np.arange(len(labels)), labels]
    if loss == "sigmoid":
        return (np.logaddexp(0.0, scores).sum(axis=1) - at_label) / scores.shape[1]
    top = scores.max(axis=1)
    return top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) - at_label


def scores_of(rows: np.ndarray, views: list) -> np.ndarray:
    for matrix, bias in views[:-1]:
        rows = np.maximum(rows @ matrix + bias, 0.0)
    matrix, bias = views[-1]
    return rows @ matrix + bias


@dataclass
class _Net:
    """What a task has to know about one network."""

    layers: list[int]
    loss: str
    dropout: list[float]
    salt: int = 0


def add_gradient(
    total: np.ndarray, net: _Net, flat: np.ndarray, x: np.ndarray, y: np.ndarray, keys: np.ndarray
) -> None:
    """Add gradient, loss, hits and rows of a block to `total` (weights, then three numbers)."""
    views = layer_views(flat, net.layers)
    inputs, masks = [x], []
    for depth, (matrix, bias) in enumerate(views[:-1]):
        hidden = np.maximum(inputs[-1] @ matrix + bias, 0.0)
        drop = net.dropout[depth] if depth < len(net.dropout) else 0.0
        mask = None
        if drop > 0.0:
            mask = keep_mask(keys, hidden.shape[1], drop, net.salt * 64 + depth).astype(x.dtype)
            hidden = hidden * mask
        inputs.append(hidden)
        masks.append(mask)
    matrix, bias = views[-1]
    scores = inputs[-1] @ matrix + bias
    delta = outputs_of(scores, net.loss)
    delta[np.arange(len(y)), y] -= 1.0
    if net.loss == "sigmoid":
        delta /= scores.shape[1]
    sums = layer_views(total[:-3], net.layers)
    for depth in range(len(views) - 1, -1, -1):
        grown, shift = sums[depth]
        grown += inputs[depth].T @ delta
        shift += delta.sum(axis=0)
        if depth:
            delta = (delta @ views[depth][0].T) * (inputs[depth] > 0)
            if masks[depth - 1] is not None:
                delta *= masks[depth - 1]
    total[-3:] += losses_of(scores, y, net.loss).sum(), (scores.argmax(axis=1) == y).sum(), len(y)


def add_scores(total: np.ndarray, net: _Net, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    scores = scores_of(x, layer_views(flat, net.layers))
    total += losses_of(scores, y, net.loss).sum(), (scores.argmax(axis=1) == y).sum(), len(y)


# ---- rows to blocks and sums over blocks ---------------------------------------------------------


def dense_rows(values: pa.Array, width: int) -> np.ndarray:
    """Arrow list array to a matrix; a null or a row of another width is an error."""
    flat = values.flatten()
    if values.null_count or flat.null_count or len(flat) != len(values) * width:
        raise ValueError(f"every feature row must hold {width} non-null numbers")
    rows = flat.to_numpy(zero_copy_only=False).reshape(len(values), width)
    if not np.isfinite(rows).all():
        raise ValueError("feature rows must hold finite numbers")
    return rows


def _pack(width: int, classes: int, batches_per_pass: int, item: str) -> Callable:
    """Task that packs rows into blocks, one open block per mini-batch."""
    room = min(BLOCK_BYTES, BUFFER_BYTES // (batches_per_pass + 1))
    limit = max(1, min(BLOCK_ROWS, room // (width * np.dtype(item).itemsize)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(slot: int) -> pa.RecordBatch:
            keys, labels, rows = (np.concatenate(part) for part in zip(*held.pop(slot)))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([slot], pa.int32()),
                    pa.array([keys.tobytes()], pa.binary()),
                    pa.array([labels.tobytes()], pa.binary()),
                    pa.array([rows.tobytes()], pa.binary()),
                ],
                names=["slot", "keys", "labels", "rows"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column(0).to_numpy()
            keys = batch.column(1).to_numpy()
            labels = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            if labels.min() < 0 or labels.max() >= classes:
                raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
            rows = dense_rows(batch.column(3), width).astype(item, copy=False)
            order = np.argsort(slots, kind="stable")
            for piece in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1):
                slot = int(slots[piece[0]])
                for start in range(0, len(piece), limit):
                    part = piece[start : start + limit]
                    held.setdefault(slot, []).append((keys[part], labels[part], rows[part]))
                    if sum(len(k) for k, _, _ in held[slot]) >= limit:
                        yield flush(slot)
        for slot in sorted(held):
            yield flush(slot)

    return run


def _summing_task(
    shared: Any, nets: list[_Net], width: int, item: str, work: str, learn: bool, whole: bool
) -> Callable:
    """Task that sums over its blocks, per network, and emits each sum whole or in chunks.

    A sum is the gradient (when learning), then loss, hits and rows of training rows, then the same
    three of held-out rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        totals = [np.zeros((len(flat) if learn else 0) + 6) for flat in weights]
        seen = False
        for batch in batches:
            for slot, keys, labels, rows in zip(*(batch.column(i) for i in range(4))):
                x = np.frombuffer(rows.as_buffer(), item).reshape(-1, width).astype(work, copy=False)
                y = np.frombuffer(labels.as_buffer(), np.int32)
                seen = True
                for total, net, flat in zip(totals, nets, weights):
                    if slot.as_py() == VALIDATION:
                        add_scores(total[-3:], net, flat, x, y)
                    else:
                        key = np.frombuffer(keys.as_buffer(), np.int64)
                        add_gradient(total[:-3], net, flat, x, y, key)
        if not seen:
            return
        for number, total in enumerate(totals):
            gradient = total[:-6].astype(work, copy=False)
            step = max(len(gradient), 1) if whole else CHUNK
            pieces = [gradient[low : low + step] for low in range(0, len(gradient), step)]
            # The six numbers stay double, whatever the arithmetic, and go as a piece of their own.
            yield _parts_batch([number] * (len(pieces) + 1), [*range(len(pieces)), COUNTS], [*pieces, total[-6:]])

    return run


def _parts_batch(nets: list[int], chunks: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(nets, pa.int32()),
            pa.array(chunks, pa.int32()),
            pa.array([part.tobytes() for part in parts], pa.binary()),
        ],
        names=["net", "chunk", "part"],
    )


def _adding_task(work: str) -> Callable:
    """Task that adds up the pieces it is given, holding one running sum per network and chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for net, chunk, part in zip(*(batch.column(i) for i in range(3))):
                key = (net.as_py(), chunk.as_py())
                values = np.frombuffer(part.as_buffer(), "float64" if key[1] == COUNTS else work)
                if key in held:
                    held[key] += values
                else:
                    held[key] = values.astype(np.float64)
        for (net, chunk), total in held.items():
            yield _parts_batch([net], [chunk], [total])

    return run


@dataclass
class _Blocks:
    """Cached row blocks of one training set and what is needed to sum over them."""

    cached: DataFrame
    frame: DataFrame
    partitions: int
    width: int
    item: str
    work: str
    batches: int
    validated: bool
    _chosen: dict[tuple, DataFrame] = field(default_factory=dict)

    def _rows(self, slots: tuple[int, ...]) -> DataFrame:
        if slots not in self._chosen:
            rows = self.frame.where(F.col("slot").isin(*slots))
            self._chosen[slots] = rows.select("slot", "keys", "labels", "rows")
        return self._chosen[slots]

    def sum(
        self, nets: list[_Net], weights: list[np.ndarray], batch: int | None, held_out: bool
    ) -> list[np.ndarray]:
        """Sums over a mini-batch, over the held-out rows, or over both in one job."""
        learn = batch is not None
        slots = ((batch,) if learn else ()) + ((VALIDATION,) if held_out else ())
        sizes = [(len(flat) if learn else 0) + 6 for flat in weights]
        whole = self.partitions * sum(sizes) * np.dtype(self.work).itemsize <= DIRECT_BYTES
        sent = [flat.astype(self.work, copy=False) for flat in weights]
        shared = self.frame.sparkSession.sparkContext.broadcast(sent)
        columns = "net int, chunk int, part binary"
        try:
            task = _summing_task(shared, nets, self.width, self.item, self.work, learn, whole)
            parts = self._rows(slots).mapInArrow(task, columns)
            if not whole:
                parts = parts.repartition("net", "chunk").mapInArrow(_adding_task(self.work), columns)
            table = parts.toArrow()
        finally:
            shared.destroy()
        sums = [np.zeros(size) for size in sizes]
        for net, chunk, part in zip(*(table.column(name) for name in ("net", "chunk", "part"))):
            total, place = sums[net.as_py()], chunk.as_py()
            if place == COUNTS:
                total[-6:] += np.frombuffer(part.as_buffer(), np.float64)
                continue
            values = np.frombuffer(part.as_buffer(), self.work if whole else "float64")
            low = 0 if whole else place * CHUNK
            total[low : low + len(values)] += values
        return sums


# ---- estimator and model -------------------------------------------------------------------------


class _PerceptronParams(
    HasFeaturesCol,
    HasLabelCol,
    HasPredictionCol,
    HasProbabilityCol,
    HasMaxIter,
    HasStepSize,
    HasSolver,
    HasRegParam,
    HasSeed,
    HasValidationIndicatorCol,
):
    layers: Param = Param(
        Params._dummy(), "layers", "units per layer, input to output", TypeConverters.toListInt
    )
    loss: Param = Param(
        Params._dummy(), "loss", "softmax or sigmoid cross-entropy", TypeConverters.toString
    )
    dropout: Param = Param(
        Params._dummy(), "dropout", "share dropped per hidden layer", TypeConverters.toListFloat
    )
    momentum: Param = Param(Params._dummy(), "momentum", "momentum of sgd", TypeConverters.toFloat)
    decay: Param = Param(
        Params._dummy(), "decay", "inverse-time decay of the sgd rate", TypeConverters.toFloat
    )
    nesterov: Param = Param(
        Params._dummy(), "nesterov", "whether sgd looks ahead", TypeConverters.toBoolean
    )
    miniBatchFraction: Param = Param(
        Params._dummy(), "miniBatchFraction", "share of the rows per step", TypeConverters.toFloat
    )
    stepsPerEpoch: Param = Param(
        Params._dummy(), "stepsPerEpoch", "steps per epoch, 0 for all rows", TypeConverters.toInt
    )
    numPartitions: Param = Param(
        Params._dummy(), "numPartitions", "parallel slots, 0 to derive them", TypeConverters.toInt
    )
    idCol: Param = Param(
        Params._dummy(), "idCol", "unique row id behind mini-batches and dropout", TypeConverters.toString
    )
    precision: Param = Param(
        Params._dummy(), "precision", "double or single arithmetic in tasks", TypeConverters.toString
    )
    earlyStopPatience: Param = Param(
        Params._dummy(), "earlyStopPatience", "epochs without better val_loss, 0 off", TypeConverters.toInt
    )
    keepBest: Param = Param(
        Params._dummy(), "keepBest", "keep the weights of the best val_loss", TypeConverters.toBoolean
    )
    checkpointPath: Param = Param(
        Params._dummy(), "checkpointPath", "where to save every new best model", TypeConverters.toString
    )
    plateauPatience: Param = Param(
        Params._dummy(), "plateauPatience", "epochs without better val_accuracy, 0 off", TypeConverters.toInt
    )
    plateauFactor: Param = Param(
        Params._dummy(), "plateauFactor", "factor on the rate at a plateau", TypeConverters.toFloat
    )
    plateauFloor: Param = Param(
        Params._dummy(), "plateauFloor", "lowest rate after plateaus", TypeConverters.toFloat
    )

    def _defaults(self) -> None:
        self._setDefault(
            featuresCol="features",
            labelCol="label",
            predictionCol="prediction",
            probabilityCol="probability",
            maxIter=20,
            stepSize=1e-3,
            solver="adam",
            regParam=0.0,
            seed=4321,
            loss="softmax",
            dropout=[],
            momentum=0.0,
            decay=0.0,
            nesterov=False,
            miniBatchFraction=1.0,
            stepsPerEpoch=0,
            numPartitions=0,
            precision="double",
            earlyStopPatience=0,
            keepBest=False,
            plateauPatience=0,
            plateauFactor=0.5,
            plateauFloor=1e-4,
        )

    def _optional(self, param: Param) -> Any:
        return self.getOrDefault(param) if self.isDefined(param) else None

    def _feature_array(self, rows: DataFrame) -> Column:
        name = self.getFeaturesCol()
        if isinstance(rows.schema[name].dataType, VectorUDT):
            return vector_to_array(name)
        return F.col(name)


@dataclass
class _Epoch:
    """Sums over the steps of an epoch."""

    number: int
    rate: float
    steps: int = 0
    loss: float = 0.0
    hits: float = 0.0
    rows: float = 0.0

    def add(self, sums: np.ndarray) -> None:
        self.steps += 1
        self.loss, self.hits, self.rows = self.loss + sums[0], self.hits + sums[1], self.rows + sums[2]

    def record(self) -> tuple:
        seen = max(self.rows, 1.0)
        return (self.number, self.steps, int(self.rows), self.rate,
                float(self.loss / seen), float(self.hits / seen))


@dataclass
class _Run:
    """State of one network while it is trained."""

    estimator: ReluPerceptronClassifier
    net: _Net
    weights: np.ndarray
    optimiser: Adam | Sgd
    stop: EarlyStop | None
    plateau: Plateau | None
    best: BestWeights | None
    history: list[tuple] = field(default_factory=list)
    open: _Epoch | None = None
    done: bool = False


class ReluPerceptronClassifier(
    Estimator, _PerceptronParams, DefaultParamsReadable, DefaultParamsWritable
):
    """Multilayer perceptron with ReLU hidden layers; see the module text for how it is trained.

    Features may be a vector or an array column. `regParam` penalises squared weights on top of the
    mean loss. With `miniBatchFraction` below one, the rows are dealt to mini-batches once, evenly,
    and every epoch goes through the batches in a new order; `stepsPerEpoch` then bounds an epoch
    and the next one goes on where it ended.
    """

    @keyword_only
    def __init__(
        self,
        *,
        layers: Sequence[int] | None = None,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        probabilityCol: str = "probability",
        maxIter: int = 20,
        stepSize: float = 1e-3,
        solver: str = "adam",
        regParam: float = 0.0,
        seed: int = 4321,
        loss: str = "softmax",
        dropout: Sequence[float] = (),
        momentum: float = 0.0,
        decay: float = 0.0,
        nesterov: bool = False,
        miniBatchFraction: float = 1.0,
        stepsPerEpoch: int = 0,
        numPartitions: int = 0,
        idCol: str | None = None,
        precision: str = "double",
        validationIndicatorCol: str | None = None,
        earlyStopPatience: int = 0,
        keepBest: bool = False,
        checkpointPath: str | None = None,
        plateauPatience: int = 0,
        plateauFactor: float = 0.5,
        plateauFloor: float = 1e-4,
    ):
        super().__init__()
        self._defaults()
        self.setParams(**self._input_kwargs)

    def setParams(self, **params: Any) -> ReluPerceptronClassifier:
        return self._set(**{k: v for k, v in params.items() if v is not None})

    def _checked_layers(self) -> list[int]:
        layers = self.getOrDefault(self.layers)
        if len(layers) < 2 or min(layers) < 1:
            raise ValueError("layers needs an input and an output size, all positive")
        if weight_count(layers) > MAX_WEIGHTS:
            raise ValueError(f"{weight_count(layers)} weights exceed the limit of {MAX_WEIGHTS}")
        if self.getSolver() not in ("adam", "sgd"):
            raise ValueError("solver must be adam or sgd")
        if self.getOrDefault(self.loss) not in ("softmax", "sigmoid"):
            raise ValueError("loss must be softmax or sigmoid")
        if self.getOrDefault(self.precision) not in ("double", "single"):
            raise ValueError("precision must be double or single")
        if not 0.0 < self.getOrDefault(self.miniBatchFraction) <= 1.0:
            raise ValueError("miniBatchFraction must lie in (0, 1]")
        return layers

    def _data_settings(self) -> tuple:
        """Everything the row blocks depend on; equal settings can share them."""
        layers = self._checked_layers()
        names = ("featuresCol", "labelCol", "miniBatchFraction", "stepsPerEpoch", "numPartitions",
                 "seed", "precision", "idCol", "validationIndicatorCol")
        return (layers[0], layers[-1], *(self._optional(self.getParam(n)) for n in names))

    def _fit(self, dataset: DataFrame) -> ReluPerceptronModel:
        return _train(dataset, [self])[0]

    def fitMultiple(
        self, dataset: DataFrame, paramMaps: Sequence[dict]
    ) -> Iterator[tuple[int, ReluPerceptronModel]]:
        variants = [self.copy(extra) for extra in paramMaps]
        return _SharedFits(dataset, variants)


class _SharedFits:
    """Thread-safe iterator of fits, where variants that can share their row blocks do."""

    def __init__(self, dataset: DataFrame, variants: list[ReluPerceptronClassifier]):
        self.dataset, self.variants = dataset, variants
        groups: dict[tuple, list[list[int]]] = {}
        for index, variant in enumerate(variants):
            sharers = groups.setdefault(variant._data_settings(), [[]])
            load = sum(weight_count(variants[i]._checked_layers()) for i in sharers[-1])
            if load + weight_count(variant._checked_layers()) > MAX_WEIGHTS:
                sharers.append([])
            sharers[-1].append(index)
        self.groups = [group for sharers in groups.values() for group in sharers]
        self.ready: list[tuple[int, ReluPerceptronModel]] = []
        self.lock = threading.Lock()

    def __iter__(self) -> _SharedFits:
        return self

    def __next__(self) -> tuple[int, ReluPerceptronModel]:
        with self.lock:
            if not self.ready:
                if not self.groups:
                    raise StopIteration
                group = self.groups.pop(0)
                models = _train(self.dataset, [self.variants[i] for i in group])
                self.ready = list(zip(group, models))
            return self.ready.pop(0)


def whole_label(label: Column) -> Column:
    """The label as an int; an error if that changes its value."""
    whole = label.cast("int")
    problem = F.concat(F.lit("labels must be whole numbers, found "), F.coalesce(label.cast("string"), F.lit("null")))
    return F.when(whole == label, whole).otherwise(F.raise_error(problem).cast("int"))


def _slotted(dataset: DataFrame, settings: ReluPerceptronClassifier, batches: int) -> DataFrame:
    """Rows with a mini-batch number and a stable key."""
    unique = settings._optional(settings.idCol)
    seed = F.lit(settings.getSeed())
    # Without an id, rows are dealt out in scan order: even for sorted or repeated rows.
    key = F.xxhash64(F.col(unique), seed) if unique else F.monotonically_increasing_id()
    marked = dataset.select(
        key.alias("key"),
        whole_label(F.col(settings.getLabelCol())).alias("label"),
        settings._feature_array(dataset).alias("features"),
        (
            F.col(settings.getValidationIndicatorCol())
            if settings._optional(settings.validationIndicatorCol)
            else F.lit(False)
        ).alias("held_out"),
    )
    slot = F.when(F.col("held_out"), VALIDATION).otherwise(F.pmod("key", F.lit(batches)))
    return marked.select(slot.cast("int").alias("slot"), "key", "label", "features")


def _slot_range(settings: ReluPerceptronClassifier, spark: SparkSession) -> tuple[int, int]:
    """Fewest and most partitions to train on.

    The number of cores may still grow when executors come and go, so the upper bound also looks at
    the parallelism set for shuffles.
    """
    wanted = settings.getOrDefault(settings.numPartitions)
    if wanted:
        return wanted, wanted
    cores = spark.sparkContext.defaultParallelism
    return cores, max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _blocks(dataset: DataFrame, settings: ReluPerceptronClassifier) -> _Blocks:
    layers = settings._checked_layers()
    batches = max(1, round(1.0 / settings.getOrDefault(settings.miniBatchFraction)))
    rows = _slotted(dataset, settings, batches)
    kind = rows.schema["features"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    work = "float32" if settings.getOrDefault(settings.precision) == "single" else "float64"
    item = "float32" if single or work == "float32" else "float64"
    if not single:
        rows = rows.withColumn("features", F.col("features").cast("array<double>"))
    pack = _pack(layers[0], layers[-1], batches, item)
    packed = "slot int, keys binary, labels binary, rows binary"
    frame = rows.mapInArrow(pack, packed).persist(StorageLevel.MEMORY_AND_DISK)
    present = frame.rdd.getNumPartitions()
    fewest, most = _slot_range(settings, dataset.sparkSession)
    if present < fewest:
        # Few input splits: only then is it worth moving rows, so that every slot has some.
        frame.unpersist()
        frame = rows.repartition(fewest).mapInArrow(pack, packed).persist(StorageLevel.MEMORY_AND_DISK)
    # Many input splits are packed as they are and read back by fewer tasks per step, which bounds
    # the number of partial sums without a shuffle.
    read = frame.coalesce(most) if present > most else frame
    slots = min(max(present, fewest), most)
    validated = settings._optional(settings.validationIndicatorCol) is not None
    return _Blocks(frame, read, slots, layers[0], item, work, batches, validated)


def _start(estimator: ReluPerceptronClassifier, validated: bool) -> _Run:
    get = estimator.getOrDefault
    layers, rate = estimator._checked_layers(), estimator.getStepSize()
    watch = {
        "earlyStopPatience": get(estimator.earlyStopPatience) > 0,
        "plateauPatience": get(estimator.plateauPatience) > 0,
        "keepBest": get(estimator.keepBest),
        "checkpointPath": estimator._optional(estimator.checkpointPath) is not None,
    }
    asked = [name for name, on in watch.items() if on]
    if asked and not validated:
        raise ValueError(f"{', '.join(asked)} need validationIndicatorCol")
    if estimator.getSolver() == "adam":
        optimiser = Adam(rate)
    else:
        optimiser = Sgd(rate, get(estimator.momentum), get(estimator.decay), get(estimator.nesterov))
    return _Run(
        estimator,
        _Net(layers, get(estimator.loss), list(get(estimator.dropout))),
        glorot_weights(layers, estimator.getSeed()),
        optimiser,
        EarlyStop(get(estimator.earlyStopPatience)) if watch["earlyStopPatience"] else None,
        Plateau(get(estimator.plateauPatience), get(estimator.plateauFactor), get(estimator.plateauFloor))
        if watch["plateauPatience"]
        else None,
        BestWeights() if watch["keepBest"] or watch["checkpointPath"] else None,
    )


def _penalty(run: _Run) -> np.ndarray:
    """Gradient of the weight penalty; biases are free."""
    pull = np.zeros_like(run.weights)
    for (target, _), (matrix, _) in zip(
        layer_views(pull, run.net.layers), layer_views(run.weights, run.net.layers)
    ):
        target[:] = run.estimator.getRegParam() * matrix
    return pull


class _BatchOrder:
    """Mini-batch numbers, every pass over the data in a new order."""

    def __init__(self, batches: int, seed: int):
        self.batches, self.seed, self.passes, self.queue = batches, seed, 0, []

    def next(self) -> int:
        if not self.queue:
            rng = np.random.default_rng([self.seed, self.passes])
            self.queue, self.passes = rng.permutation(self.batches).tolist(), self.passes + 1
        return self.queue.pop(0)


def _train(
    dataset: DataFrame, estimators: list[ReluPerceptronClassifier]
) -> list[ReluPerceptronModel]:
    lead = estimators[0]
    held_out = lead._optional(lead.validationIndicatorCol)
    if (dataset.where(~F.col(held_out)) if held_out else dataset).isEmpty():
        raise ValueError("there are no training rows")
    blocks = _blocks(dataset, lead)
    try:
        runs = [_start(e, blocks.validated) for e in estimators]
        steps = lead.getOrDefault(lead.stepsPerEpoch) or blocks.batches
        order, taken = _BatchOrder(blocks.batches, lead.getSeed()), 0
        waiting: list[_Run] = []
        for epoch in range(max(e.getMaxIter() for e in estimators)):
            active = [r for r in runs if not r.done and epoch < r.estimator.getMaxIter()]
            for step in range(steps):
                for run in active:
                    run.net.salt = run.estimator.getSeed() * 1_000_003 + taken
                taken += 1
                # Scores of held-out rows after an epoch come with the first step of the next one:
                # both need the same weights.
                sums = blocks.sum(
                    [r.net for r in active], [r.weights for r in active], order.next(), bool(waiting)
                )
                if waiting:
                    for run, total in zip(active, sums):
                        _close_epoch(run, total[-3:])
                    sums = [total for run, total in zip(active, sums) if not run.done]
                    active, waiting = [r for r in active if not r.done], []
                for run, total in zip(active, sums):
                    _step(run, total[:-3], epoch, first=step == 0)
                if not active:
                    break
            if not active:
                break
            last = any(epoch + 1 == r.estimator.getMaxIter() for r in active)
            if blocks.validated and not last:
                waiting = active
                continue
            held = [np.zeros(3)] * len(active)
            if blocks.validated:
                held = blocks.sum([r.net for r in active], [r.weights for r in active], None, True)
            for run, total in zip(active, held):
                _close_epoch(run, total[-3:])
    finally:
        blocks.cached.unpersist()
    return [_finish(run) for run in runs]


def _step(run: _Run, total: np.ndarray, epoch: int, first: bool) -> None:
    """One update from a summed gradient, loss, hits and rows."""
    if first:
        run.open = _Epoch(epoch, run.optimiser.rate)
    run.open.add(total[-3:])
    if total[-1] == 0:
        return
    gradient = total[:-3] / total[-1]
    if run.estimator.getRegParam() > 0:
        gradient += _penalty(run)
    run.weights = run.optimiser.update(run.weights, gradient)


def _close_epoch(run: _Run, valid: np.ndarray) -> None:
    """Record an epoch and decide from its held-out scores how to go on."""
    checked = valid[2] > 0
    val_loss = float(valid[0] / valid[2]) if checked else None
    val_accuracy = float(valid[1] / valid[2]) if checked else None
    run.history.append((*run.open.record(), val_loss, val_accuracy))
    if not checked:
        return
    if run.best is not None and run.best.seen(run.open.number, val_loss, run.weights):
        path = run.estimator._optional(run.estimator.checkpointPath)
        if path:
            _model_of(run, run.weights).write().overwrite().save(path)
    if run.plateau is not None:
        run.optimiser.rate = run.plateau.rate_after(val_accuracy, run.optimiser.rate)
    if run.stop is not None and run.stop.seen(val_loss):
        run.done = True


def _model_of(run: _Run, weights: np.ndarray) -> ReluPerceptronModel:
    model = ReluPerceptronModel(weights, list(run.history))
    return run.estimator._copyValues(model)


def _finish(run: _Run) -> ReluPerceptronModel:
    keep = run.estimator.getOrDefault(run.estimator.keepBest) and run.best.weights is not None
    return _model_of(run, run.best.weights if keep else run.weights)


class ReluPerceptronModel(Model, _PerceptronParams, MLReadable, MLWritable):
    """Fitted perceptron: flat weights and the training history."""

    def __init__(self, weights: np.ndarray | None = None, history: list[tuple] | None = None):
        super().__init__()
        self._defaults()
        self.weights = weights
        self._history = history or []
        self._shared = None

    @property
    def history(self) -> DataFrame:
        """One row per epoch: rate, loss and accuracy on training and held-out rows."""
        return SparkSession.active().createDataFrame(self._history, HISTORY_SCHEMA)

    def copy(self, extra: dict | None = None) -> ReluPerceptronModel:
        twin = super().copy(extra)
        twin.weights, twin._history, twin._shared = self.weights, self._history, self._shared
        return twin

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers, loss = self.getOrDefault(self.layers), self.getOrDefault(self.loss)
        if self._shared is None:
            self._shared = dataset.sparkSession.sparkContext.broadcast(self.weights)
        shared = self._shared

        @F.arrow_udf("array<double>")
        def probabilities(rows: pa.Array) -> pa.Array:
            views = layer_views(shared.value, layers)
            x = dense_rows(rows, layers[0])
            parts = [
                outputs_of(scores_of(x[start : start + BLOCK_ROWS].astype(np.float64), views), loss)
                for start in range(0, len(x), BLOCK_ROWS)
            ]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * layers[-1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

        scored = dataset.withColumn("_probabilities", probabilities(self._feature_array(dataset)))
        return (
            scored.withColumn(self.getProbabilityCol(), array_to_vector("_probabilities"))
            .withColumn(self.getPredictionCol(), arg_max(F.col("_probabilities")).cast("double"))
            .drop("_probabilities")
        )

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: ReluPerceptronModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        starts = np.arange(0, len(self.model.weights), CHUNK)
        offsets = np.append(starts, len(self.model.weights)).astype(np.int32)
        table = pa.table(
            {
                "chunk": pa.array(np.arange(len(starts), dtype=np.int32)),
                "part": pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.model.weights)),
            }
        )
        spark.createDataFrame(table).write.parquet(f"{path}/weights")
        self.model.history.coalesce(1).write.parquet(f"{path}/history")


class _ModelReader(MLReader):
    def load(self, path: str) -> ReluPerceptronModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        table = spark.read.parquet(f"{path}/weights").toArrow().sort_by("chunk")
        weights = table.column("part").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        history = spark.read.parquet(f"{path}/history").orderBy("epoch").collect()
        model = ReluPerceptronModel(weights.copy(), [tuple(r) for r in history])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
