"""Toxicity with a bidirectional gated recurrent network and attention pooling, trained in numpy.

A text is read as windows of `WINDOW` words that overlap by half; every window is scored, and the highest one
is the text's. A word enters as a hashed word vector beside the mean of its hashed character trigrams, so
forms that training has not seen are read by their letters. Training takes a bounded sample of labelled
documents; of each, only the highest windows teach, as a toxic document may hold one toxic passage.

Defined results: a null text is the empty text; a text without words has score 0; without labels of both kinds every score is 0;
rows are kept each; labels that are null, or repeated with different values, are used as they are; only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.text import chunks, lowered, span_hashes, text_of, word_bounds

SAMPLE_PER_CLASS = 1000  # labelled documents of each kind that are learned from
CALIBRATION = 5  # one in so many of them sets the scale instead
WINDOW, STRIDE = 32, 16
COMMON = 3  # a word has a vector of its own if so many learned documents hold it
TRIGRAM_ROWS = 1 << 13
DROPOUT = 0.2  # of the input numbers, while learning
DECAY = 1e-3
WORD_SIZE, TRIGRAM_SIZE, HIDDEN, ATTENTION = 8, 16, 12, 8
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 700, 32, 0.005
WARM = 3  # the first epochs, one in so many, take random windows
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 20
WINDOWS_AT_ONCE = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


# ---- reading -------------------------------------------------------------------------------------


@dataclass
class Words:
    """Distinct words of a chunk (hash, trigram buckets and their bounds), and its windows."""

    hashes: np.ndarray
    trigrams: np.ndarray
    bounds: np.ndarray
    windows: np.ndarray  # index of a distinct word, -1 beyond the end
    owner: np.ndarray  # text of each window


def read_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of ASCII letters and digits and of all bytes beyond ASCII, in lower case."""
    raw = lowered(raw)
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    raw = np.where(inside, raw, np.uint8(32))
    starts, ends, bounds = word_bounds(raw, offsets)
    hashes, first, place = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    cuts = np.zeros(len(first) + 1, np.int64)
    np.cumsum(lengths, out=cuts[1:])
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], lengths) + np.repeat(starts[first], lengths)
    middle = raw[at].astype(np.uint64)
    before = np.where(np.isin(np.arange(len(at)), cuts[:-1]), 32, raw[np.maximum(at - 1, 0)]).astype(np.uint64)
    after = np.where(np.isin(np.arange(len(at)), cuts[1:] - 1), 32, raw[np.minimum(at + 1, len(raw) - 1)]).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (before << np.uint64(16) | middle << np.uint64(8) | after) * np.uint64(0x9E3779B97F4A7C15)
    trigrams = (code >> np.uint64(40)).astype(np.int64) % TRIGRAM_ROWS
    counts = np.diff(bounds)
    spots = np.where(counts > 0, np.maximum(1, -(-(counts - STRIDE) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(counts)), spots)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(spots) - spots, spots)
    index = (turn * STRIDE)[:, None] + np.arange(WINDOW)
    valid = index < counts[owner][:, None]
    index = np.minimum(bounds[owner][:, None] + index, max(len(place) - 1, 0))
    windows = np.where(valid, place[index] if len(place) else -1, -1)
    return Words(hashes, trigrams, cuts, windows, owner)


# ---- network -------------------------------------------------------------------------------------


def start_weights(common: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_SIZE + TRIGRAM_SIZE
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = {
        "common": common,
        "word": (0.1 * rng.normal(size=(len(common) + 1, WORD_SIZE))).astype(np.float32),
        "trigram": (0.3 * rng.normal(size=(TRIGRAM_ROWS, TRIGRAM_SIZE))).astype(np.float32),
        "attend": draw(2 * HIDDEN, ATTENTION),
        "focus": draw(ATTENTION),
        "out": draw(2 * HIDDEN),
        "bias": np.zeros(1, np.float32),
    }
    for way in ("f", "b"):
        weights |= {f"in_{way}": draw(size, 3 * HIDDEN), f"add_{way}": np.zeros(3 * HIDDEN, np.float32), f"state_{way}": draw(HIDDEN, 3 * HIDDEN)}
    return weights


def word_rows(w: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """Row of the word table: 0 for words that are not common."""
    common = w["common"]
    if not len(common):
        return np.zeros(len(words.hashes), np.int64)
    at = np.minimum(np.searchsorted(common, words.hashes), len(common) - 1)
    return np.where(common[at] == words.hashes, at + 1, 0)


def common_words(words: Words) -> np.ndarray:
    """Sorted hashes of the words that at least `COMMON` texts hold."""
    owner = np.repeat(words.owner, words.windows.shape[1])
    word = words.windows.ravel()
    pairs = np.unique(np.stack([word, owner])[:, word >= 0], axis=1)[0]
    return words.hashes[np.flatnonzero(np.bincount(pairs, minlength=len(words.hashes)) >= COMMON)]


def word_inputs(w: dict[str, np.ndarray], words: Words) -> np.ndarray:
    lengths = np.maximum(np.diff(words.bounds), 1)[:, None]
    letters = np.add.reduceat(w["trigram"][words.trigrams], words.bounds[:-1], axis=0) / lengths
    return np.concatenate([w["word"][word_rows(w, words)], letters.astype(np.float32)], axis=1)


def recur(w: dict, way: str, gates: np.ndarray, windows: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden state after each step, forwards or backwards; `keep` remembers what the gradient needs."""
    count, steps = windows.shape
    state = np.zeros((count, HIDDEN), np.float32)
    out = np.zeros((count, steps, HIDDEN), np.float32)
    tape = []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        valid = (windows[:, t] >= 0)[:, None]
        x = gates[windows[:, t]]
        u = state @ w[f"state_{way}"]
        both = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = both[:, :HIDDEN], both[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = np.where(valid, n + z * (state - n), state)
        if keep:
            tape.append((t, state, z, r, n, u[:, 2 * HIDDEN :], valid))
        state = new
        out[:, t] = state
    return out, tape


def logits(w: dict, words: Words, windows: np.ndarray, inputs: np.ndarray, keep: bool = False):
    """Logit of each window; with `keep` also what the gradient needs."""
    runs = {way: recur(w, way, inputs @ w[f"in_{way}"] + w[f"add_{way}"], windows, keep) for way in ("f", "b")}
    hidden = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    bent = np.tanh(hidden @ w["attend"])
    weight = np.where(windows >= 0, bent @ w["focus"], -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", weight, hidden)
    out = pooled @ w["out"] + w["bias"][0]
    return (out, (runs, hidden, bent, weight, pooled)) if keep else out


def gradient(w: dict, words: Words, windows: np.ndarray, inputs: np.ndarray, target: np.ndarray, amount: np.ndarray, mask: np.ndarray | float = 1.0) -> dict:
    """Gradient of the weighted logistic loss of some windows."""
    out, (runs, hidden, bent, weight, pooled) = logits(w, words, windows, inputs, keep=True)
    d_out = ((sigmoid(out) - target) * amount / amount.sum()).astype(np.float32)
    g = {name: np.zeros_like(value) for name, value in w.items() if name != "common"}
    g["out"], g["bias"] = pooled.T @ d_out, d_out.sum(keepdims=True)
    d_pooled = d_out[:, None] * w["out"]
    d_weight = np.einsum("bh,bth->bt", d_pooled, hidden)
    d_hidden = weight[:, :, None] * d_pooled[:, None, :]
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    d_bent = d_score[:, :, None] * w["focus"] * (1 - bent * bent)
    g["focus"] = np.einsum("bt,bta->a", d_score, bent)
    g["attend"] = np.einsum("bth,bta->ha", hidden, d_bent)
    d_hidden = d_hidden + d_bent @ w["attend"].T
    d_inputs = np.zeros_like(inputs)
    for k, way in enumerate(("f", "b")):
        recurrent = w[f"state_{way}"]
        d_gates = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
        carry = np.zeros((len(windows), HIDDEN), np.float32)
        for t, state, z, r, n, un, valid in reversed(runs[way][1]):
            d = carry + d_hidden[:, t, k * HIDDEN : (k + 1) * HIDDEN]
            live = np.where(valid, d, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            d_state = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"state_{way}"] += state.T @ d_state
            carry = np.where(valid, live * z, d) + d_state @ recurrent.T
            np.add.at(d_gates, windows[:, t][valid[:, 0]], np.concatenate([dz, dr, dn], axis=1)[valid[:, 0]])
        g[f"in_{way}"], g[f"add_{way}"] = inputs.T @ d_gates, d_gates.sum(axis=0)
        d_inputs += d_gates @ w[f"in_{way}"].T
    d_inputs *= mask
    np.add.at(g["word"], word_rows(w, words), d_inputs[:, :WORD_SIZE])
    lengths = np.diff(words.bounds)
    np.add.at(g["trigram"], words.trigrams, np.repeat(d_inputs[:, WORD_SIZE:] / np.maximum(lengths, 1)[:, None], lengths, axis=0))
    return g


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None
    slope: float = 1.0
    shift: float = 0.0

    def top_logits(self, words: Words, texts: int) -> np.ndarray:
        """Highest logit among all windows of each text; minus infinity without words."""
        top = np.full(texts, -np.inf)
        if len(words.windows):
            inputs = word_inputs(self.weights, words)
            for k in range(0, len(words.windows), WINDOWS_AT_ONCE):
                part = logits(self.weights, words, words.windows[k : k + WINDOWS_AT_ONCE], inputs)
                np.maximum.at(top, words.owner[k : k + WINDOWS_AT_ONCE], part)
        return top

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.weights is not None:
            for first, end, raw, offsets in chunks(column, CHUNK_BYTES):
                top = self.top_logits(read_words(raw, offsets), end - first)
                with np.errstate(over="ignore"):
                    out[first:end] = 1 / (1 + np.exp(-(self.slope * top + self.shift)))
        return out


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """From (text, label) rows. Toxic texts teach by their highest window, others by their three highest."""
    order = np.random.default_rng(seed).permutation(len(rows))
    rows = [rows[i] for i in order if rows[i][0]]
    labels = np.array([label for _, label in rows], np.float32)
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(None)
    held = np.arange(len(rows)) % CALIBRATION == 0
    if len({*labels[~held]}) < 2:
        held[:] = False
    column = pa.array([text for text, _ in rows])
    (_, _, raw, offsets), = chunks(column, 1 << 40)
    words = read_words(raw, offsets)
    w = start_weights(common_words(words), seed)
    model = Model(w)
    first, second = ({k: np.zeros_like(v) for k, v in w.items() if k != "common"} for _ in range(2))
    rng = np.random.default_rng(seed)
    used = ~held[words.owner]
    share = labels[~held].mean()
    step, per_epoch = 0, max(1, 2 * int((~held).sum()) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // per_epoch))
    for epoch in range(epochs):
        inputs = word_inputs(w, words)
        score = np.concatenate([logits(w, words, words.windows[k : k + WINDOWS_AT_ONCE], inputs) for k in range(0, len(words.windows), WINDOWS_AT_ONCE)])
        if epoch < epochs // WARM:
            score = rng.random(len(score))
        by_text = np.lexsort((-score, words.owner))
        rank = np.arange(len(by_text)) - np.searchsorted(words.owner[by_text], words.owner[by_text])
        label = labels[words.owner[by_text]]
        chosen = by_text[used[by_text] & (rank < (4 if epoch < epochs // WARM else np.where(label == 1, 1, 3)))]
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), BATCH):
            part = chosen[k : k + BATCH]
            sub, target = subset(words, words.windows[part]), labels[words.owner[part]]
            amount = np.where(target == 1, 1 - share, share / 2).astype(np.float32)
            mask = (rng.random((len(sub.hashes), WORD_SIZE + TRIGRAM_SIZE)) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
            g = gradient(w, sub, sub.windows, word_inputs(w, sub) * mask, target, amount, mask)
            step += 1
            for name, value in g.items():
                first[name] += 0.1 * (value - first[name])
                second[name] += 0.001 * (value * value - second[name])
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                w[name] -= RATE * DECAY * w[name]
                w[name] -= rate * first[name] / (np.sqrt(second[name]) + 1e-8)
    top = model.top_logits(words, len(rows))
    calibrate(model, top[held] if held.any() else top, labels[held] if held.any() else labels)
    return model


def subset(words: Words, windows: np.ndarray) -> Words:
    """The distinct words of some windows only."""
    used, place = np.unique(windows, return_inverse=True)
    place = place.reshape(windows.shape)
    if used[0] < 0:
        used, place = used[1:], place - 1
    lengths = np.diff(words.bounds)[used]
    bounds = np.zeros(len(used) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths) + np.repeat(words.bounds[:-1][used], lengths)
    return Words(words.hashes[used], words.trigrams[at], bounds, place, np.arange(len(windows)))


def calibrate(model: Model, top: np.ndarray, labels: np.ndarray) -> None:
    """Shift the logits so that `THRESHOLD` is where the F1 of the held-out sample is highest."""
    finite = np.isfinite(top)
    top, labels = top[finite], labels[finite]
    values = np.unique(top)
    cuts = np.concatenate([values[:1] - 1, (values[1:] + values[:-1]) / 2, values[-1:] + 1])
    hits = np.array([((top >= c) & (labels == 1)).sum() for c in cuts])
    f1 = 2 * hits / np.maximum(np.array([(top >= c).sum() for c in cuts]) + (labels == 1).sum(), 1)
    good = cuts[f1 == f1.max()]
    gap = np.median(good)
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * gap)


# ---- Spark ---------------------------------------------------------------------------------------


def sample(rows: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, most: int = SAMPLE_PER_CLASS) -> list[tuple[str, int]]:
    """At most `most` labelled documents of each kind, those of smallest id hash, in a fixed order."""
    order = F.xxhash64(id_column, F.lit("toxicity"))
    known = labels.where(F.col(label).isin(0, 1)).select(id_column, F.col(label).alias("_label"), order.alias("_order"))
    parts = [known.where(F.col("_label") == k).orderBy("_order", id_column).limit(most) for k in (0, 1)]
    wanted = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * `most` rows of three numbers
    found = rows.join(wanted, id_column).select("_order", F.col(text).alias("_text"), "_label").collect()
    return [(r["_text"], r["_label"]) for r in sorted(found, key=lambda r: (r["_order"], r["_text"] or "", r["_label"]))]


def score(rows: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) per row."""
    kind = rows.schema[id_column].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], [id_column, "score"])

    return rows.select(id_column, text_of(text).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, score double")
