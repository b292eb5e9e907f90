"""Language-model scores of whole texts: a causal self-attention model on subword ids, and word counts.

The model is one attention layer over windows of `WINDOW` ids. It gives the class of the next id, and the id
within its class follows from its count. Everything is learned from all training documents: ids are counted
and clustered by their neighbours over the whole corpus, and the weights, started on the driver with a bounded
sample, take steps over every window of every task's documents and are averaged over the tasks, an input
vector by how often the task saw its id. A task's documents hang on hashes of id and text alone and are
taken in that order, so neither the cluster nor the layout of the input changes the score. Windows overlap: the first scores all its places, every further one
those that no window has scored, so each token is scored once, with `WINDOW - STRIDE` tokens of context at
least.

Beside it stands a smoothed unigram score of words over the counts of all training documents. Counts are
summed in Spark; the most frequent words, a bounded number, are broadcast, and the others of a document
meet their counts in a shuffle.

Defined results: a null text is the empty text, which consists of the end token alone; without training
documents counts are 0 and the model is untrained but normalised; rows are kept each, equal ones with
equal scores; only the id and text columns are read, so other columns cannot clash. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import subwords, window_graph
from vectorloom.llm.text import chunks, give_back, lowered, span_hashes, text_of, word_bounds
from vectorloom.operators.sizing import settle_as_table

SAMPLE_DOCS = 500  # documents on which the driver starts the weights
WINDOW, STRIDE = 32, 24
WIDTH, HIDDEN = 8, 16
CLASSES = 64
NEIGHBOURS, SHARED = 150, 42  # neighbours with a feature of their own; the others share so many by hash
PROJECTED = 64
EPOCHS, BATCH, RATE = 4, 256, 0.01
CORPUS_RATE = 0.002
TOKENS_AT_ONCE = 200_000
PART_TOKENS = 4_000_000  # about what one task takes steps on
SMOOTHING = 0.1
START, END = 49406, subwords.END
WINDOWS_AT_ONCE = 256  # their logits stay in a core's cache
COMMON_WORDS = 300_000  # broadcast with their counts, 16 bytes each
END_HASH = -1
COUNTED_AT_ONCE = 2_000_000


# ---- the attention model -------------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    row_of: np.ndarray  # id -> row of the input table, each its own
    class_of: np.ndarray
    within: np.ndarray  # log probability of an id within its class

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and targets of all windows (target -1: not scored here), and the text of each."""
        lengths = np.array([len(ids) + 1 for ids in texts], np.int64)
        edge, over = np.array([END, START], np.int32), np.full(WINDOW, START, np.int32)
        stream = np.concatenate([edge[1:], *(part for ids in texts for part in (ids, edge)), over], dtype=np.int32, casting="unsafe")
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(len(texts)), counts)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (begins[owner] + turn * STRIDE)[:, None] + np.arange(WINDOW)
        inputs = stream.take(at)
        targets = stream[1:].take(at)
        ends = np.cumsum(counts) - 1  # only the last window of a text may reach beyond it
        beyond = (turn[ends] * STRIDE)[:, None] + np.arange(WINDOW) >= lengths[:, None]
        inputs[ends] = np.where(beyond, START, inputs[ends])
        targets[ends] = np.where(beyond, -1, targets[ends])
        targets[turn > 0, : WINDOW - STRIDE] = -1
        return inputs, targets, owner

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text, its end included."""
        out = np.zeros(len(texts))
        inputs, targets, owner = self.windows(texts)
        for first, chosen in scored_from(targets):
            for k in range(0, len(chosen), WINDOWS_AT_ONCE):
                part = chosen[k : k + WINDOWS_AT_ONCE]
                wanted = targets[part, first:]
                target = np.maximum(wanted, 0)
                value = log_chances(self.weights, self.row_of.take(inputs[part]), self.class_of.take(target), first)
                value = np.where(wanted >= 0, value + self.within.take(target), 0)
                out += np.bincount(owner[part], value.sum(axis=1), len(texts))
        return out


def scored_from(targets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Windows by the place from which they are scored; those that begin a text are scored whole."""
    later = targets[:, 0] < 0
    return [(first, np.flatnonzero(part)) for first, part in ((0, ~later), (WINDOW - STRIDE, later))]


MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def forward(w: dict[str, np.ndarray], rows: np.ndarray):
    """Class logits at each place of each window, from the places up to it; and what the gradient needs."""
    count, size = rows.shape
    x = w["input"][rows] + w["place"]
    flat = x.reshape(-1, WIDTH)
    q, k, v = ((flat @ w[n]).reshape(count, size, WIDTH) for n in ("query", "key", "value"))
    scores = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + MASK
    scores -= scores.max(axis=2, keepdims=True)
    weight = np.exp(scores, out=scores)
    weight /= weight.sum(axis=2, keepdims=True)
    seen = weight @ v
    both = np.concatenate([x, seen], axis=2).reshape(-1, 2 * WIDTH)
    hidden = np.tanh(both @ w["mix"] + w["mix_add"])
    logits = (hidden @ w["out"] + w["out_add"]).reshape(count, size, -1)
    return logits, (rows, x, q, k, v, weight, both, hidden)


def bounded(w: dict[str, np.ndarray]) -> bool:
    """Whether no logit can leave the range in which its exponential is exact; hidden values lie within 1."""
    return float((np.abs(w["out"]).sum(axis=0) + np.abs(w["out_add"])).max()) < 40


def log_sums(w: dict[str, np.ndarray], logits: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the last axis."""
    ones = np.ones(logits.shape[-1], logits.dtype)
    if bounded(w):
        return np.log(np.exp(logits) @ ones)
    top = logits.max(axis=-1)
    return np.log(np.exp(logits - top[..., None]) @ ones) + top


def log_chances(w: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, first: int) -> np.ndarray:
    """Log probability of the classes (windows x scored places), which begin at place `first`."""
    if window_graph.runtime():
        return window_graph.log_chances(w, rows, classes, first)
    logits = forward(w, rows)[0][:, first:]
    return np.take_along_axis(logits, classes[:, :, None], axis=2)[:, :, 0] - log_sums(w, logits)


def gradient(w: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross-entropy of the classes (-1: not scored)."""
    if not window_graph.runtime():
        return plain_gradient(w, rows, classes)
    total, size = np.count_nonzero(classes >= 0), w["input"].size
    g = {name: np.zeros_like(value) for name, value in w.items() if name != "input"}
    g["input"] = np.zeros(size)
    for first, chosen in scored_from(classes):
        if len(chosen):
            found, d_x = window_graph.gradient(w, rows[chosen], classes[chosen, first:], first, total)
            for name, value in found.items():
                g[name] += value
            g["place"] += d_x.sum(axis=0)
            cells = (rows[chosen][:, :, None] * WIDTH + np.arange(WIDTH)).ravel()
            g["input"] += np.bincount(cells, d_x.ravel(), size)
    return g | {"input": g["input"].reshape(w["input"].shape).astype(np.float32)}


def plain_gradient(w: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """The same in numpy, for where ONNX Runtime is missing."""
    logits, (rows, x, q, k, v, weight, both, hidden) = forward(w, rows)
    count, size = rows.shape
    flat = logits.reshape(-1, logits.shape[2])
    p = np.exp(flat - log_sums(w, flat)[:, None])
    label = classes.ravel()
    used = label >= 0
    here = np.arange(len(label)), np.maximum(label, 0)
    p[here] -= 1
    d = p
    d *= (used / used.sum()).astype(p.dtype)[:, None]
    g = {"out": hidden.T @ d, "out_add": d.sum(axis=0)}
    d_mix = (d @ w["out"].T) * (1 - hidden * hidden)
    g["mix"], g["mix_add"] = both.T @ d_mix, d_mix.sum(axis=0)
    d_both = (d_mix @ w["mix"].T).reshape(count, size, -1)
    d_x, d_seen = d_both[:, :, :WIDTH].copy(), d_both[:, :, WIDTH:]
    d_weight = d_seen @ v.transpose(0, 2, 1)
    d_v = weight.transpose(0, 2, 1) @ d_seen
    d_scores = weight * (d_weight - (weight * d_weight).sum(axis=2, keepdims=True)) * WIDTH**-0.5
    d_q, d_k = d_scores @ k, d_scores.transpose(0, 2, 1) @ q
    inputs = x.reshape(-1, WIDTH)
    for name, part in (("query", d_q), ("key", d_k), ("value", d_v)):
        part = part.reshape(-1, WIDTH)
        g[name] = inputs.T @ part
        d_x += (part @ w[name].T).reshape(d_x.shape)
    g["place"] = d_x.sum(axis=0)
    g["input"] = np.zeros_like(w["input"])
    seen_rows, at = np.unique(rows.ravel(), return_inverse=True)
    for k, part in enumerate(d_x.reshape(-1, WIDTH).T):
        g["input"][seen_rows, k] = np.bincount(at.ravel(), part, len(seen_rows))
    return g


def start_weights(size: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) * shape[0] ** -0.5).astype(np.float32)
    return {
        "input": (0.5 * rng.normal(size=(size, WIDTH))).astype(np.float32),
        "place": (0.1 * rng.normal(size=(WINDOW, WIDTH))).astype(np.float32),
        "query": draw(WIDTH, WIDTH),
        "key": draw(WIDTH, WIDTH),
        "value": draw(WIDTH, WIDTH),
        "mix": draw(2 * WIDTH, HIDDEN),
        "mix_add": np.zeros(HIDDEN, np.float32),
        "out": draw(HIDDEN, CLASSES),
        "out_add": np.zeros(CLASSES, np.float32),
    }


def features_of(counts: np.ndarray) -> np.ndarray:
    """Feature of every id as a neighbour: the most frequent have their own, the others share by hash."""
    size = len(counts)
    out = NEIGHBOURS + (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % SHARED
    top = np.argsort(-counts, kind="stable")[:NEIGHBOURS]
    out[top] = np.arange(len(top))
    return out


def add_neighbours(table: np.ndarray, texts: list[np.ndarray], feature: np.ndarray) -> None:
    """Count into `table` (ids x features, those before an id in the second half) who stands beside whom."""
    flat, half = table.reshape(-1), table.shape[1] // 2
    for shift, one, other in ((0, slice(None, -1), slice(1, None)), (half, slice(1, None), slice(None, -1))):
        cells = [ids[one] * table.shape[1] + feature[ids[other]] + shift for ids in texts]
        if cells:
            np.add.at(flat, np.concatenate(cells), table.dtype.type(1))


def projected(rows: np.ndarray, seed: int = 3) -> np.ndarray:
    """Points of the feature counts `rows`, whose distances are about those of the square roots of the shares."""
    shares = np.sqrt(rows / np.maximum(rows.sum(axis=1, keepdims=True), 1))
    axes = np.random.default_rng(seed).normal(size=(rows.shape[1], PROJECTED)) * PROJECTED**-0.5
    return (shares @ axes).astype(np.float32)


def cluster(ids: np.ndarray, points: np.ndarray, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Class of every id: k-means on the `points` of all `ids` seen, weighted by the roots of their counts.

    The last class is the end; the last but one holds the ids that never occur.
    """
    classes = np.full(len(counts), CLASSES - 2, np.int64)
    if len(ids) >= CLASSES:
        weight = np.sqrt(counts[ids].astype(float))
        points = points - np.average(points, axis=0, weights=weight)
        values, axes = np.linalg.eigh(points.T @ (points * weight[:, None]))
        points = points @ axes[:, np.argsort(-values)[:16]]
        rng = np.random.default_rng(seed)
        centres = points[rng.choice(len(points), CLASSES - 2, replace=False, p=weight / weight.sum())]
        for _ in range(25):
            near = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            held = np.bincount(near, weight, CLASSES - 2)
            sums = np.stack([np.bincount(near, weight * x, CLASSES - 2) for x in points.T], axis=1)
            centres[held > 0] = sums[held > 0] / held[held > 0, None]
        classes[ids] = near
    classes[END] = CLASSES - 1
    return classes


def untrained(counts: np.ndarray, ids: np.ndarray, points: np.ndarray, seed: int = 3) -> Model:
    """Classes and the chances within them from the counts of all ids; weights at their start."""
    classes = cluster(ids, points, counts, seed)
    members = np.bincount(classes, minlength=CLASSES)
    totals = np.bincount(classes, counts, CLASSES)
    within = np.log((counts + SMOOTHING) / (totals + SMOOTHING * members)[classes])
    return Model(start_weights(len(counts), seed), np.arange(len(counts)), classes, within)


class Steps:
    """Adam steps on the weights of a model, which change in place; its input vectors do at the `end`.

    Only the input vectors seen so far are held: the others have no gradient yet and would not move.
    """

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.rows = np.empty(0, np.int64)
        self.slot = np.full(len(model.weights["input"]), -1, np.int64)
        self.weights = model.weights | {"input": np.empty((0, WIDTH), np.float32)}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))

    def hold(self, rows: np.ndarray) -> np.ndarray:
        """The places at which the input vectors of `rows` are held from now on."""
        slots = self.slot.take(rows)
        new = np.unique(rows[slots < 0])
        if len(new):
            self.slot[new] = len(self.rows) + np.arange(len(new))
            self.rows = np.concatenate([self.rows, new])
            self.weights["input"] = np.concatenate([self.weights["input"], self.model.weights["input"][new]])
            for moment in (self.first, self.second):
                moment["input"] = np.concatenate([moment["input"], np.zeros((len(new), WIDTH), np.float32)])
            slots = self.slot.take(rows)
        return slots

    def take(self, inputs: np.ndarray, target: np.ndarray, rate: float) -> None:
        w, classes = self.weights, self.model.class_of
        held = self.hold(self.model.row_of.take(inputs))
        g = gradient(w, held, np.where(target >= 0, classes.take(np.maximum(target, 0)), -1))
        self.step += 1
        rate *= np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, value in g.items():
            self.first[name] += 0.1 * (value - self.first[name])
            self.second[name] += 0.001 * (value * value - self.second[name])
            w[name] -= (rate * self.first[name] / (np.sqrt(self.second[name]) + 1e-8)).astype(np.float32)

    def end(self) -> None:
        self.model.weights["input"][self.rows] = self.weights["input"]


def start(model: Model, texts: list[np.ndarray], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Epochs over the ids of a few texts with a falling rate."""
    if not texts:
        return model
    inputs, targets, _ = model.windows(texts)
    rng, taken = np.random.default_rng(seed), Steps(model)
    steps = max(1, epochs * -(-len(inputs) // BATCH))
    for _ in range(epochs):
        shuffled = rng.permutation(len(inputs))
        for k in range(0, len(shuffled), BATCH):
            part = shuffled[k : k + BATCH]
            taken.take(inputs[part], targets[part], RATE * (1 - 0.9 * (taken.step + 1) / steps))
    taken.end()
    return model


def train(texts: list[np.ndarray], size: int, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """From the ids of texts on one machine; `size` ids exist."""
    counts = np.zeros(size, np.int64)
    for ids in texts:
        counts += np.bincount(ids, minlength=size)
    table = np.zeros((size, 2 * (NEIGHBOURS + SHARED)), np.int32)
    add_neighbours(table, texts, features_of(counts))
    ids = np.flatnonzero(counts)
    points = projected(table[ids])
    counts[END] += len(texts)
    return start(untrained(counts, ids, points, seed), texts, epochs, seed)


# ---- learning from the whole corpus --------------------------------------------------------------


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def some_texts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[list[np.ndarray]]:
    """The ids of the texts in the first column, about `TOKENS_AT_ONCE` at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            held.append(np.frombuffer(raw.as_buffer(), kind).astype(np.int64))
            size += len(held[-1]) + 1
            if size >= TOKENS_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_ids(learned: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all texts (ids), the end once a text; `size` numbers reach the driver."""
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for texts in some_texts(batches, kind):
            counts += np.bincount(np.concatenate(texts), minlength=size)
            counts[END] += len(texts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])
        give_back()

    found = learned.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def neighbour_points(learned: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids seen and their points, from the neighbours in all texts."""
    size, width, kind = len(counts), 2 * (NEIGHBOURS + SHARED), id_type(len(counts))
    feature = features_of(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, width), np.int32)
        for texts in some_texts(batches, kind):
            add_neighbours(table, texts, feature)
        for k in range(0, size, 4096):
            one, at = np.nonzero(table[k : k + 4096])
            arrays = [pa.array(one + k), pa.array(at.astype(np.int32)), pa.array(table[k : k + 4096][one, at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "at", "n"])
        del table, arrays
        give_back()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                table = np.zeros((part.num_rows, width))
                for row, cells in zip(table, part.column(1).to_pylist()):
                    for cell in cells:
                        row[cell["at"]] = cell["n"]
                raw = [x.tobytes() for x in projected(table)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["id", "point"])
        give_back()

    cells = learned.mapInArrow(count, "id long, at int, n long").groupBy("id", "at").agg(F.sum("n").alias("n"))
    rows = cells.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("cells"))
    found = rows.mapInArrow(project, "id long, point binary").toPandas()
    ids = found["id"].to_numpy(np.int64)
    points = np.frombuffer(b"".join(found["point"]), np.float32).reshape(len(ids), PROJECTED)
    order = np.argsort(ids)
    return ids[order], points[order]


def corpus_steps(learned: DataFrame, model: Model) -> Model:
    """Each task takes steps over all windows of its texts; the weights are then averaged over the tasks.

    An input vector counts as often as the task saw its id, other weights as often as it saw a window. What
    reaches the driver is one number a weight.
    """
    names, kind = list(model.weights), id_type(len(model.class_of))
    shared = learned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        mine = Model({k: v.copy() for k, v in kept.weights.items()}, kept.row_of, kept.class_of, kept.within)
        taken, rng = Steps(mine), np.random.default_rng(5)
        seen, windows = np.zeros(len(mine.weights["input"])), 0
        for texts in some_texts(batches, kind):
            inputs, targets, _ = mine.windows(texts)
            windows += len(inputs)
            seen += np.bincount(mine.row_of.take(inputs.ravel()), minlength=len(seen))
            for part in np.array_split(rng.permutation(len(inputs)), -(-len(inputs) // BATCH)):
                taken.take(inputs[part], targets[part], CORPUS_RATE)
        if not windows:
            return
        taken.end()
        for k, name in enumerate(names):
            value = mine.weights[name].reshape(-1).astype(np.float64)
            weight = np.repeat(seen, WIDTH) if name == "input" else np.full(len(value), float(windows))
            at = np.flatnonzero(weight)
            arrays = [pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(value[at] * weight[at]), pa.array(weight[at])]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "at", "value", "weight"])
        del mine, taken, arrays
        give_back()

    parts = learned.mapInArrow(run, "name int, at long, value double, weight double").groupBy("name", "at")
    found = parts.agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
    for k, part in found.groupby("name"):
        model.weights[names[k]].reshape(-1)[part["at"].to_numpy(np.int64)] = part["value"].to_numpy(np.float32)
    return model


def sample(learned: DataFrame, size: int, docs: int = SAMPLE_DOCS) -> list[np.ndarray]:
    """The ids of at most `docs` rows, those of smallest hash."""
    found = learned.orderBy(F.xxhash64("ids"), "ids").limit(docs).collect()
    return [np.frombuffer(r["ids"], id_type(size)).astype(np.int64) for r in found]


def learn(learned: DataFrame, size: int) -> Model:
    """From all texts (id, ids) of a settled table; `size` ids exist. How the rows lie changes nothing.

    Counts are whole numbers and add up the same in any parts; steps are taken in parts of about `PART_TOKENS`
    that hang on hashes of id and text. Rows equal in both lie in one part.
    """
    name = learned.columns[0]
    held = learned.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-held // (PART_TOKENS * np.dtype(id_type(size)).itemsize)))
    texts = learned.select("ids")
    tasks = texts.coalesce(max(1, parts // 2))
    counts = count_ids(tasks, size)
    model = start(untrained(counts, *neighbour_points(tasks, counts)), sample(texts, size))
    keyed = learned.select("ids", F.xxhash64(name, "ids").alias("key")).repartition(parts, "key")
    return corpus_steps(keyed.sortWithinPartitions("key", "ids"), model)


# ---- word counts ---------------------------------------------------------------------------------


def count_words(rows: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word hash occurs in all texts, the end token counted once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = texts = 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in batches:
            texts += batch.num_rows
            for _, _, raw, offsets in chunks(batch.column(0)):
                raw = lowered(raw)
                starts, ends, _ = word_bounds(raw, offsets)
                held.append(span_hashes(raw, starts, ends))
                size += len(starts)
                if size >= COUNTED_AT_ONCE:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH], pa.int64()), pa.array([texts], pa.int64())], ["word", "n"])
        give_back()

    counted = rows.select(text_of(text).alias("text")).mapInArrow(run, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words above a count that at most `most` words reach, sorted, with their counts.

    It is the smallest power of two with that property; the end token is always among them.
    """
    level = F.floor(F.log2("n")).cast("int").alias("level")
    by_level = {r["level"]: r["k"] for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("k")).collect()}
    least = 0
    while sum(k for x, k in by_level.items() if x >= least) > most:
        least += 1
    found = counts.where((F.col("n") >= 2**least) | (F.col("word") == END_HASH)).toPandas().sort_values("word")
    return found["word"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


class SortedWords:
    """Places of word hashes in a sorted table, by the leading bits and a short search."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.int64(64 - max(1, len(words).bit_length() + 1))
        half = 1 << (63 - int(self.shift))
        self.begins = np.searchsorted(words >> self.shift, np.arange(-half, half + 1)).astype(np.int32)
        self.most, self.half = int(np.diff(self.begins).max()), half

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        place = np.full(len(hashes), -1, np.int64)
        if len(self.words):
            at = self.begins.take((hashes >> self.shift) + self.half)
            for _ in range(self.most):
                np.minimum(at, len(self.words) - 1, out=at)
                np.copyto(place, at, where=self.words.take(at) == hashes)
                at += 1
        return place


def rest_words(hashes: np.ndarray, rows: np.ndarray, count: int) -> tuple[pa.Array, pa.Array]:
    """Per row its distinct words and how often each occurs, as lists; `rows` ascends."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    offsets = pa.array(np.searchsorted(rows[at], np.arange(count + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes[at], np.diff(np.append(at, len(rows)))))


def first_pass(rows: DataFrame, id_column: str, words: np.ndarray, counts: np.ndarray, path: str, coding: str) -> DataFrame:
    """Per row (id, text, judged, learned): key, id, tokens, known ones and their log sum among the common words, the rest, subword ids."""
    kind = rows.schema[id_column].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((words, np.log10(counts + 0.5)))
    names = ["row", id_column, "judged", "learned", "n_tokens", "known", "logs", "rest", "times", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = shared.value
        table, encode = SortedWords(words), subwords.NumberedWords(subwords.encoder(path), len(words) + 1).encode
        end = table.find(np.array([END_HASH]))[0]
        has_end, logs = end >= 0, np.append(logs, 0.0)  # the last is that of a word not found
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, raw, offsets in chunks(batch.column(1), 1 << 20):
                small = lowered(raw)
                starts, ends, bounds = word_bounds(small, offsets)
                hashes = span_hashes(small, starts, ends).view(np.int64)
                place, count = table.find(hashes), last - first
                hit = place >= 0
                sums, known = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1, np.int64)
                np.cumsum(logs[place], out=sums[1:])
                np.cumsum(hit, out=known[1:])
                others = np.flatnonzero(~hit)
                lists = rest_words(hashes[others], np.searchsorted(bounds, others, side="right") - 1, count)
                ids, ends_at = encode(raw, offsets, starts, ends, bounds, place)
                ids, ends_at = ids.astype(coding), (ends_at * np.dtype(coding).itemsize).astype(np.int32)
                arrays = [
                    pa.array(row + np.arange(count)),
                    *[batch.column(k).slice(first, count) for k in (0, 2, 3)],
                    pa.array(np.diff(bounds) + 1),
                    pa.array(np.diff(known[bounds]) + int(has_end)),
                    pa.array(np.diff(sums[bounds]) + (logs[end] if has_end else np.log10(0.5))),
                    *lists,
                    pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(ends_at), pa.py_buffer(ids)]),
                ]
                row += count
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    counted = "n_tokens long, known long, logs double, rest array<long>, times array<long>"
    return rows.mapInArrow(run, f"row long, `{id_column}` {kind}, judged boolean, learned boolean, {counted}, ids binary")


def model_scores(passed: DataFrame, model: Model) -> DataFrame:
    """`passed` (…, ids) with the logarithm to base 10 of the model's probability, `score`, in place of the ids."""
    shared, kind = passed.sparkSession.sparkContext.broadcast(model), id_type(len(model.class_of))
    kept = [c for c in passed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.select([batch.schema.names[0]])
            scores = [shared.value.score(texts) / np.log(10) for texts in some_texts(iter([held]), kind)]
            column = pa.array(np.concatenate(scores) if scores else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], [*kept, "score"])
        give_back()

    fields = ", ".join(f"`{c}` {kind_of}" for c, kind_of in passed.select(*kept).dtypes)
    return passed.select("ids", *kept).mapInArrow(run, f"{fields}, score double")


def score_texts(rows: DataFrame, training: DataFrame | Column, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score and score, learning from `training`.

    `training` is a table, or the condition under which a row of `rows` is learned; then each text is encoded once.
    """
    path = tokenizer or subwords.default_path()
    size = subwords.encoder(path).tokenizer.get_vocab_size()
    judged = [F.col(id_column), text_of(text).alias("text"), F.lit(True).alias("judged")]
    if isinstance(training, Column):
        both = rows.select(*judged, F.coalesce(training, F.lit(False)).alias("learned"))
        training = rows.where(training)
    else:
        own = F.col(id_column) if id_column in training.columns else F.lit(None)
        learned = training.select(own.cast(rows.schema[id_column].dataType).alias(id_column), text_of(text).alias("text"), F.lit(False).alias("judged"), F.lit(True).alias("learned"))
        both = rows.select(*judged, F.lit(False).alias("learned")).unionByName(learned)
    counts = settle_as_table(count_words(training, text), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words, held = common_words(counts)
    encoded = settle_as_table(first_pass(both, id_column, words, held, path, id_type(size)), "encoded")
    model = learn(encoded.where("learned").select(id_column, "ids"), size)
    passed = encoded.where("judged").drop("judged", "learned")
    each = passed.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w"))
    each = each.select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    met = each.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more_logs"),
    )
    out = model_scores(passed.drop("rest", "times"), model).join(met, "row", "left")
    norm = float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    return out.select(
        id_column,
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )
