"""Language identification with interpolated Kneser-Ney character models.

Per language, counts of character n-grams of a bounded sample give interpolated Kneser-Ney probabilities; of
all languages together, one sorted array of n-gram hashes per order holds them side by side. A text is read
whole; the language with the lowest cross-entropy per character wins. From a part of the sample that is
kept out of the counts come the scale of the score and, per language, the cross-entropy beyond which a text
is marked as rejected.

Characters are letters in lower case; all else counts as one space between words.

Defined results: a null text or one without letters is `und` with score 0; so is every text if there is nothing
to learn from; equal cross-entropies give the first language by name; rows are kept each; only the id, text
and language columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.text import mix, text_of, worker_cache

ORDER = 4
SAMPLE_DOCS = 250  # learned documents per language, about
CALIBRATION = 5  # one in so many of them is kept out of the counts
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"
SPACE = 32
MULTIPLIERS = mix(np.arange(1, ORDER + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def letters() -> np.ndarray:
    kept = worker_cache()
    if "letters" not in kept:
        kept["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return kept["letters"]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, where each begins (len + 1 values), and which have a letter."""
    small = [" " + t.lower() for t in texts]
    codes = np.frombuffer("".join(small).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(small) + 1, np.int64)
    np.cumsum([len(t) for t in small], out=starts[1:])
    codes = np.where(letters()[codes], codes, SPACE).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    keep[starts[:-1][starts[:-1] < len(codes)]] = True
    kept = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    found = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes != SPACE, out=found[1:])
    return codes[keep], kept[starts], np.diff(found[starts]) > 0


def keys(codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order 1..`order`: hashes of the n-gram that ends at each place, and of its context."""
    begin = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(len(codes))
    gram, context = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    grams, contexts = [], []
    with np.errstate(over="ignore"):
        for j in range(order):
            back = place - j
            symbol = codes if j == 0 else np.where(back >= begin, codes[np.maximum(back, 0)], np.uint64(SPACE))
            gram = gram + symbol * MULTIPLIERS[j]
            if j:
                context = context + symbol * MULTIPLIERS[j - 1]
            grams.append(mix(gram + np.uint64(j)))
            contexts.append(mix(context + np.uint64(j)))
    return grams, contexts


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # per order, sorted hashes
    logs: list[np.ndarray]  # natural log probability, one column per language
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]  # log of the mass left to the lower order
    floor: float  # log probability of an unseen symbol
    scale: float = 30.0
    limits: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character, a row per text and a column per language; which have letters."""
        codes, starts, real = symbols(texts)
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        grams, contexts = keys(codes, starts, len(self.grams))
        left = np.arange(len(codes))
        for n in range(len(self.grams) - 1, -1, -1):
            at, hit = find(self.grams[n], grams[n][left])
            out[left[hit]] += self.logs[n][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            at, hit = find(self.contexts[n], contexts[n][left])
            out[left[hit]] += self.backoffs[n][at[hit]]
        out[left] += self.floor
        sums = np.zeros((len(codes) + 1, out.shape[1]))
        np.cumsum(out, axis=0, dtype=np.float64, out=sums[1:])
        return -(sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(np.diff(starts), 1)[:, None], real

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) per text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        entropy, real = self.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        odds = np.exp(-self.scale * (entropy - least[:, None]))
        over = np.maximum(least - self.limits[best], 0.0)
        score = np.exp(-over) / odds.sum(axis=1)
        return [
            (self.languages[b], float(s), float(e), bool(o > 0)) if r else (UNKNOWN, 0.0, None, True)
            for b, s, e, o, r in zip(best, score, least, over, real)
        ]


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, table[at] == wanted if len(table) else np.zeros(len(wanted), bool)


def count_model(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of different left neighbours below."""
    languages = sorted(texts)
    read = {}
    for language in languages:
        codes, starts, _ = symbols(texts[language])
        read[language] = (codes, *keys(codes, starts, order))
    vocabulary = len(np.unique(np.concatenate([read[x][0] for x in languages]))) + 1
    grams, logs, contexts, backoffs = [], [], [], []
    lower: np.ndarray | None = None  # probabilities of the order below
    for n in range(order):
        union, first = np.unique(np.concatenate([read[x][1][n] for x in languages]), return_index=True)
        of_context = np.concatenate([read[x][2][n] for x in languages])[first]
        contexts_of, context = np.unique(of_context, return_inverse=True)
        if n:
            suffix, _ = find(grams[n - 1], np.concatenate([read[x][1][n - 1] for x in languages])[first])
        table = np.zeros((len(union), len(languages)))
        left = np.ones((len(contexts_of), len(languages)))
        for column, language in enumerate(languages):
            hashes = read[language][1]
            if n < order - 1:  # one vote per different longer n-gram
                _, one = np.unique(hashes[n + 1], return_index=True)
                seen, counts = np.unique(hashes[n][one], return_counts=True)
            else:
                seen, counts = np.unique(hashes[n], return_counts=True)
            held = np.zeros(len(union))
            held[np.searchsorted(union, seen)] = counts
            once, twice = (held == 1).sum(), (held == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(context, held, len(contexts_of))
            kinds = np.bincount(context, held > 0, len(contexts_of))
            mass = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = lower[suffix, column] if n else 1.0 / vocabulary
            own = np.maximum(held - discount, 0) / np.maximum(total[context], 1)
            table[:, column] = own + mass[context] * below
            left[:, column] = mass
        grams.append(union)
        logs.append(np.log(table).astype(np.float32))
        contexts.append(contexts_of)
        backoffs.append(np.log(left).astype(np.float32))
        lower = table
    return Model(languages, grams, logs, contexts, backoffs, float(-np.log(vocabulary)))


def train(rows: list[tuple[str, str]], order: int = ORDER) -> Model:
    """From (language, text) rows; every `CALIBRATION`-th row of a language calibrates."""
    texts: dict[str, list[str]] = {}
    held: list[tuple[str, str]] = []
    seen: dict[str, int] = {}
    for language, text in rows:
        seen[language] = k = seen.get(language, 0) + 1
        if k % CALIBRATION == 0:
            held.append((language, text))
        else:
            texts.setdefault(language, []).append(text)
    if not texts:
        return Model([], [], [], [], [], 0.0)
    model = count_model(texts, order)
    model.limits = np.full(len(model.languages), np.inf)
    if held:
        entropy, real = model.entropies([t for _, t in held])
        truth = np.array([model.languages.index(x) for x, _ in held])
        own = entropy[np.arange(len(held)), truth]
        for k in range(len(model.languages)):
            mine = own[real & (truth == k)]
            if len(mine):
                model.limits[k] = mine.mean() + 5 * mine.std() + 0.25
        scales = [1.0, 3.0, 10.0, 30.0, 100.0]
        odds = [np.log(np.exp(-s * (entropy - own[:, None])).sum(axis=1))[real].sum() for s in scales]
        model.scale = scales[int(np.argmin(odds))]
    return model


def sample(rows: DataFrame, id_column: str, text: str, language: str, docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """About `docs` whole documents per language, picked by hash of the id, in a fixed order."""
    usable = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    share = usable.groupBy(language).agg((F.lit(float(docs)) / F.count(F.lit(1))).alias("_share"))
    pick = F.pmod(F.xxhash64(id_column, F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    shares = {r[language]: r["_share"] for r in share.collect()}
    wanted = F.coalesce(*[F.when(F.col(language) == k, v) for k, v in sorted(shares.items())], F.lit(0.0))
    found = usable.where(pick < wanted).select(language, text).collect()
    return sorted((str(r[0]), r[1]) for r in found)


def identify(rows: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) per row."""
    kind = rows.schema[id_column].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [id_column, "lang_pred", "score", "cross_entropy", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, first, size = batch.column(1).to_pylist(), [], 0, 0
            for k, content in enumerate(texts):
                size += len(content)
                if size >= CHUNK_CHARS or k == len(texts) - 1:
                    out += shared.value.predict(texts[first : k + 1])
                    first, size = k + 1, 0
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array([row[i] for row in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    narrow = rows.select(id_column, text_of(text).alias("text"))
    schema = f"`{id_column}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    return narrow.mapInArrow(run, schema)
